"""Functions of the user's own: what they take and give is checked."""

import pandas as pd
import pytest

from parley.operators import hooks

PAIRS = "id int, ref string, hyp string, gap string"


def pairs(spark):
    return spark.createDataFrame([(1, "a b", "a", "old"), (2, "", "x", "old"), (3, "c", "c", None)], PAIRS).repartition(2)


def test_a_scorer_adds_its_columns(spark):
    hook = hooks.Hook(lambda p: pd.DataFrame({"gap": p["ref"].str.len() - p["hyp"].str.len()}), ("ref", "hyp"), "gap long")
    got = hooks.scored(pairs(spark), hook)
    assert got.columns == ["id", "ref", "hyp", "gap"]
    assert {r.id: r.gap for r in got.collect()} == {1: 2, 2: -1, 3: 0}


@pytest.mark.parametrize(
    "function,words",
    [
        (lambda p: pd.DataFrame({"other": [1] * len(p)}), "columns"),
        (lambda p: pd.DataFrame({"gap": [1] * (len(p) + 1)}), "rows"),
        (lambda p: [1], "not a frame"),
        (lambda p: pd.DataFrame({"gap": ["text"] * len(p)}), "gap"),
    ],
)
def test_what_a_hook_gives_is_checked(spark, function, words):
    with pytest.raises(Exception, match=words):
        hooks.scored(pairs(spark), hooks.Hook(function, ("ref",), "gap long")).collect()


def test_what_a_hook_takes_is_checked(spark):
    with pytest.raises(ValueError, match="nothing"):
        hooks.scored(pairs(spark), hooks.Hook(lambda p: p, ("nothing",), "gap long"))
    with pytest.raises(ValueError, match="start, end and label"):
        hooks.provided_turns(pairs(spark), hooks.Hook(lambda p: p, ("ref",), "start double"), 10.0)


def test_frames_are_scored_one_for_one(spark):
    frames = spark.createDataFrame([("r", n, [float(n)] * 3) for n in range(50)], "recording_id string, frame_no long, mic array<double>").repartition(3)
    got = hooks.scored(frames, hooks.Hook(lambda f: pd.DataFrame({"score": [x[0] * 2 for x in f["mic"]]}), ("mic",), "score double"))
    assert all(r.score == 2 * r.frame_no for r in got.collect()) and got.count() == 50


def test_turns_come_by_stretches_in_order(spark):
    rows = [("r", float(t)) for t in range(25)] + [("s", None), ("s", 1.0)]
    df = spark.createDataFrame(rows, "recording_id string, start double").repartition(4)

    def provider(p):
        return pd.DataFrame({"start": [p["start"].min()], "end": [p["start"].max()], "label": [f"n{len(p)}"]})

    got = hooks.provided_turns(df, hooks.Hook(provider, ("start",), "start double, end double, label string"), 10.0).collect()
    assert sorted((r.seq, r.start, r.end, r.label) for r in got if r.recording_id == "r") == [
        (0, 0.0, 9.0, "n10"), (1_000_000, 10.0, 19.0, "n10"), (2_000_000, 20.0, 24.0, "n5"),
    ]
    assert [r.label for r in got if r.recording_id == "s"] == ["n2"]
    none = df.filter("false")
    assert hooks.provided_turns(none, hooks.Hook(provider, ("start",), "start double, end double, label string"), 10.0).count() == 0


def test_turns_of_the_query_are_found_once(spark, tmp_path):
    from parley.catalog import QUERIES, hooks as catalog

    calls = spark.sparkContext.accumulator(0)
    plain = catalog._halves

    def counted(words):
        calls.add(1)
        return plain(words)

    turns = [(c, t, "assistant", "one two three four") for c in range(5) for t in range(2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    catalog._halves = counted
    try:
        found = QUERIES["turns_by_hook"](spark, str(tmp_path))
        assert {(r.label, r.words) for r in found.collect()} == {("Them 1", 2), ("Them 2", 2)}
    finally:
        catalog._halves = plain
    assert calls.value == 10
