"""Hand cases and models of the ordered transcript operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parley.operators import ordered
from parley.operators import transcripts as tr
from parley.plans import calls
from parley.sinks import notes

WORDS = "recording_id string, channel int, seq long, start double, end double, text string"
TURNS = "recording_id string, seq long, start double, end double, label string"


def words(spark, rows, channel=0, rid="a"):
    return spark.createDataFrame([(rid, channel, i, *r) for i, r in enumerate(rows)], WORDS)


def test_pause_splits(spark):
    w = words(spark, [(0.0, 0.4, "Morning"), (0.4, 0.8, "team."), (0.9, 1.0, ""), (6.0, 6.5, "Thanks")])
    got = [(r.text, r.start, r.end, r.speaker.kind) for r in tr.utterances(w).orderBy("start").collect()]
    assert got == [("Morning team.", 0.0, 0.8, "me"), ("Thanks", 6.0, 6.5, "me")]


def test_pause_of_exactly_the_gap_does_not_split(spark):
    w = words(spark, [(0.0, 1.0, "a"), (2.5, 3.0, "b")])
    assert tr.utterances(w).count() == 1


def test_no_words_no_segments(spark):
    assert tr.utterances(words(spark, []).limit(0)).count() == 0


def test_turn_attribution_and_speaker_change(spark):
    w = words(spark, [(0.0, 0.5, "Hi"), (0.5, 1.0, "there"), (2.0, 2.5, "Hello"), (2.5, 3.0, "back")], 1)
    t = spark.createDataFrame([("a", 0, 0.0, 1.2, "Them 1"), ("a", 1, 1.8, 3.2, "Them 2")], TURNS)
    got = [(r.speaker.label, r.text) for r in tr.diarized_utterances(w, t).orderBy("start").collect()]
    assert got == [("Them 1", "Hi there"), ("Them 2", "Hello back")]


def test_without_turns_the_fallback_label(spark):
    w = words(spark, [(0.0, 0.5, "Hello"), (0.6, 1.0, "world")], 1)
    none = spark.createDataFrame([], TURNS)
    got = [(r.speaker.label, r.text) for r in tr.diarized_utterances(w, none).collect()]
    assert got == [("Them", "Hello world")]


def test_nearest_turn_far_away(spark):
    w = words(spark, [(5100.0, 5100.4, "late")], 1)
    t = spark.createDataFrame([("a", 0, 0.0, 4.0, "Them 1"), ("a", 1, 9999.0, 9999.5, "Them 2")], TURNS)
    assert tr.attribute(w, t).first().label == "Them 2"


def model_label(s, e, turns):
    if not turns:
        return "Them"
    over = [max(min(e, t[2]) - max(s, t[1]), 0) for t in turns]
    if max(over) > 0:
        return [t for t, o in zip(turns, over) if o == max(over)][-1][3]
    m = (s + e) / 2
    away = [t[1] - m if m < t[1] else m - t[2] if m > t[2] else 0 for t in turns]
    return turns[away.index(min(away))][3]


def test_attribution_equals_model_on_random_input(spark):
    rng = random.Random(5)
    w_rows, t_rows, want = [], [], {}
    for rid in map(str, range(12)):
        turns = []
        for q in range(rng.randrange(0, 12)):
            s = rng.randrange(0, 400) / 2
            turns.append((q, s, s + rng.choice([0, 1, 5, 90]), f"L{q}"))
        t_rows += [(rid, *t) for t in turns]
        for i in range(80):
            s = rng.randrange(0, 500) / 2
            e = s + rng.choice([0.0, 0.5, 1.0, 40.0])
            w_rows.append((rid, 1, i, s, e, "w"))
            want[rid, i] = model_label(s, e, turns)
    got = tr.attribute(spark.createDataFrame(w_rows, WORDS), spark.createDataFrame(t_rows, TURNS))
    assert {(r.recording_id, r.seq): r.label for r in got.collect()} == want


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_chunk_size_never_changes_runs(spark, chunk):
    rng = random.Random(chunk)
    rows, want = [], []
    for key in "abc":
        run = None
        for i in range(40):
            v = rng.randrange(3)
            rows.append((key, i * 2, v, f"{i}"))
            if run and run[1] == v:
                run[2].append(f"{i}")
            else:
                run = (key, v, [f"{i}"])
                want.append(run)
    df = spark.createDataFrame(rows, "k string, n long, v int, t string")
    got = ordered.islands(
        df, ["k"], ["n"], ordered.row_chunk("n", chunk), ["v"], lambda p, c: p("v") != c("v"),
        {"v": ordered.first("v"), "t": ordered.joined("t", ","), "n": ordered.rows()},
    )
    assert sorted((r.k, r.v, r.t, r.n) for r in got.collect()) == sorted((k, v, ",".join(t), len(t)) for k, v, t in want)


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_running_total_across_chunks(spark, chunk):
    df = spark.range(50).select((F.col("id") % 2).alias("k"), "id")
    got = ordered.running_total(df, ["k"], ["id"], ordered.row_chunk("id", chunk), F.col("id"), "s")
    want = {i: sum(range(i % 2, i + 1, 2)) for i in range(50)}
    assert {r.id: r.s for r in got.collect()} == want


def test_punctuation(spark):
    rows = [
        ("punctuation", "?", None, None), ("pronunciation", "Hi", 0.0, 0.5), ("punctuation", ",", None, None),
        ("pronunciation", "lost", None, None), ("punctuation", "!", None, None), ("pronunciation", "", 1.0, 1.5),
        ("pronunciation", "you", 2.0, 2.5),
    ]
    df = spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], "k string, seq long, type string, content string, start double, end double")
    got = [(r.text, r.start, r.end) for r in tr.glue_punctuation(df, ["k"], 2).orderBy("seq").collect()]
    assert got == [("Hi,!", 0.0, 0.5), ("you", 2.0, 2.5)]


def test_subwords_with_offset(spark):
    rows = [("▁Hel", 0.0, 0.1), ("lo", 0.1, 0.2), ("▁wor", 0.5, 0.1), ("ld", 0.6, 0.3), ("▁", 1.0, 0.1)]
    df = spark.createDataFrame([("a", i, *r, 10.0) for i, r in enumerate(rows)], "k string, seq long, token string, timestamp double, duration double, offset double")
    got = [(r.text, round(r.start, 6), round(r.end, 6)) for r in tr.join_subwords(df, ["k"]).orderBy("seq").collect()]
    assert got == [("Hello", 10.0, 10.3), ("world", 10.5, 10.9)]


def test_markdown(spark):
    w = words(spark, [(0.0, 2.5, "Hey,"), (3661.0, 3662.0, " late ")])
    ids = spark.createDataFrame([("a",), ("silent",)], "recording_id string")
    got = {(r.recording_id, r.part): r.markdown for r in calls.rendered_calls(ids, w).collect()}
    assert got == {
        ("a", 0): "**[00:00] Me:** Hey,\n\n",
        ("a", 1): "**[1:01:01] Me:** late\n\n",
        ("silent", 0): "_(no speech transcribed)_\n",
    }


def test_header_rewrite(spark):
    body = "---\ntitle: x\nmade: {}\n  old: 1\ntags: [a]\n---\n# T\nState: transcribing\n\nold text\n"
    df = spark.createDataFrame([(body,), ("no header\nState: transcribing\n",)], "b string")
    got = [r[0] for r in df.select(notes.rewrite_note(F.col("b"), F.lit("NEW"), "made", F.lit("made: {\"v\":1}\n"))).collect()]
    assert got == ["---\ntitle: x\nmade: {\"v\":1}\ntags: [a]\n---\n# T\nNEW", None]


def test_windows_split_utterances(spark):
    w = words(spark, [(299.0, 299.9, "a"), (300.0, 300.5, "b")])
    got = sorted((r.window_no, r.text) for r in calls.windowed_segments(w, 300.0).collect())
    assert got == [(0, "a"), (1, "b")]


def test_no_shuffle_is_by_key_alone(spark):
    """A hot key is spread by its chunks; only edge pieces share a lane."""
    hot = (F.col("id") >= 0).cast("string").alias("k")
    df = spark.range(4000).select(hot, "id", (F.col("id") % 7 == 0).alias("new")).repartition(3)
    runs = ordered.islands(
        df, ["k"], ["id"], ordered.row_chunk("id", 100), ["new"], lambda p, c: c("new"), {"n": ordered.rows()}
    )
    plan = runs._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    by = [re.sub(r"#\d+L?", "", s).split(", ")[:-1] for s in shuffles]
    assert by == [["k", "_lane"], ["k", "_chunk"]]
    got = runs.collect()
    assert len(got) == 572 and sum(r.n for r in got) == 4000


def test_ordered_work_keeps_all_tasks_of_the_session(spark):
    from parley.catalog.calls import service_json

    items = spark.createDataFrame(
        [(f"r{k}", 1, i, "pronunciation", f"w{i}", float(i), i + 0.5) for k in range(40) for i in range(5)],
        "recording_id string, channel int, seq long, type string, content string, start double, end double",
    )
    assert tr.glue_punctuation(items, ["recording_id", "channel"]).rdd.getNumPartitions() == 4
    words = items.select("recording_id", "channel", "seq", "start", "end", F.col("content").alias("text"))
    for channels in (True, False):
        assert service_json(words, channels).rdd.getNumPartitions() == 4
