"""Distances, normalizing, assignment and alignment against brute force."""

import difflib
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.functions import distance, text
from parley.operators import alignment, scoring


def table(a, b):
    row = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        nxt = [(i + 1, 0)]
        for j, y in enumerate(b):
            nxt.append(
                min(
                    (row[j + 1][0] + 1, row[j + 1][1]),
                    (nxt[j][0] + 1, nxt[j][1]),
                    row[j] if x == y else (row[j][0] + 1, row[j][1] + 1),
                )
            )
        row = nxt
    return row[-1]


def test_distances_equal_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 14))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 14))]
        edits, subs = table(a, b)
        assert distance.bit_distance(a, b) == edits
        s, d, i = distance.edit_counts(a, b)
        assert (s + d + i, s) == (edits, subs)
        assert len(a) - d + i == len(b)


def test_both_paths_agree(spark):
    rng = random.Random(4)
    rows = []
    for n in (0, 1, 5, 30, 300):
        a = [f"w{rng.randrange(20)}" for _ in range(n)]
        b = [w for w in a if rng.random() > 0.2] + ["end"]
        rows.append((" ".join(a), " ".join(b), table(a, b)[0]))
    df = spark.createDataFrame(rows, "a string, b string, want long")
    got = df.select(distance.token_distance(F.col("a"), F.col("b")).alias("d"), "want").collect()
    assert all(r.d == r.want for r in got)


CASES = [
    ("It’s “fine” — OK?", "it's fine okay"),
    ("[LAUGHTER] well (coughs) yes", "well yes"),
    ("[a [b] c] d", "d"),
    ("(see 2) 'quoted' re-do -x y-", "see 2 quoted re-do x y"),
    ("rock 'n' roll's end'", "rock n roll's end"),
    ("café Å", "café å"),
    ("a b\tc\n", "a b c"),
    (None, ""),
]


@pytest.mark.parametrize("raw,want", CASES)
def test_normalizer(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.normalize(F.col("t"))).first()[0] == want


def test_rates_without_reference_are_null(spark):
    df = spark.createDataFrame([("", "a b"), ("a b c d", "a x d d")], "ref string, hyp string")
    got = scoring.word_error_rates(df).orderBy("ref").collect()
    assert got[0].wer_normalized is None and got[0].insertions == 2
    assert (got[1].substitutions, got[1].deletions, got[1].insertions, got[1].wer_normalized) == (2, 0, 0, 0.5)


def test_assignment_equals_permutations():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 6)
        cost = [[float(rng.randrange(20)) for _ in range(n)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert scoring.best_assignment(cost) == best


def test_speaker_error_rate(spark):
    schema = "recording_id string, speaker_key string, text string"
    ref = spark.createDataFrame([("r", "A", "one two three"), ("r", "B", "four five"), ("s", "A", "x")], schema)
    hyp = spark.createDataFrame(
        [("r", "h1", "four five"), ("r", "h2", "one two"), ("r", "h3", "noise")] + [("s", f"h{i}", "x") for i in range(9)], schema
    )
    got = {r.recording_id: r for r in scoring.speaker_error_rate(ref, hyp, ["recording_id"], 8).collect()}
    # h2 for A loses one word, h3 is unmatched and costs its word.
    assert got["r"].errors == 2 and got["r"].cpwer == 0.4 and got["r"].speaker_count_error == 1
    assert got["s"].cpwer is None and got["s"].note


def test_missing_side_costs_all_words(spark):
    schema = "recording_id string, speaker_key string, text string"
    ref = spark.createDataFrame([("r", "A", "one two")], schema)
    none = spark.createDataFrame([], schema)
    got = scoring.speaker_error_rate(ref, none, ["recording_id"]).first()
    assert (got.errors, got.hyp_speakers, got.cpwer) == (2, 0, 1.0)


def test_clip_span(spark):
    ref = " ".join(f"w{i}" for i in range(400))
    clip = " ".join(["oops"] + [f"W{i}," for i in range(100, 150)] + ["uh"] + [f"w{i}" for i in range(150, 180)])
    df = spark.createDataFrame([(1, ref, clip), (2, "a b", "x y")], "id int, ref string, hyp string")
    one, two = alignment.align_clips(df).orderBy("id").collect()
    assert (one.raw_start, one.raw_end, one.matched_words, one.hyp_words) == (100, 179, 80, 82)
    assert one.span_text.startswith("w100 ") and one.coverage == round(80 / 82, 4)
    assert two.error and two.coverage is None


def test_runs_of_shared_shingles(spark):
    mk = lambda rows, k: alignment.shingles(
        spark.createDataFrame(rows, f"{k} int, t string"), k, F.split("t", " "), 3
    )
    clips = mk([(1, "a b c d e f")], "clip_id")
    refs = mk([(7, "z a b c d z a b c")], "ref_id")
    got = alignment.best_spans(alignment.clip_matches(clips, refs), 3).collect()
    assert [(r.ref_start, r.words, r.runs) for r in got] == [(1, 4, 2)]


def test_many_speakers_are_scored(spark):
    schema = "recording_id string, speaker_key string, text string"
    ref = spark.createDataFrame([("r", f"s{i}", f"w{i} x{i}") for i in range(25)], schema)
    hyp = spark.createDataFrame([("r", f"h{i}", f"w{i} x{i}" if i else "w0 oops") for i in range(25)], schema)
    got = scoring.speaker_error_rate(ref, hyp, ["recording_id"]).first()
    assert (got.errors, got.ref_words, got.note) == (1, 50, None)


def test_edit_counts_inside_the_band():
    rng = random.Random(9)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        b = [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        n, m = len(a), len(b)
        table = {(i, 0): (i, 0) for i in range(n + 1)} | {(0, j): (j, 0) for j in range(m + 1)}
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                (e, s), (e1, s1), (e2, s2) = table[i - 1, j - 1], table[i - 1, j], table[i, j - 1]
                d = int(a[i - 1] != b[j - 1])
                table[i, j] = min((e + d, s + d), (e1 + 1, s1), (e2 + 1, s2))
        s, d, i = distance.edit_counts(a, b)
        assert (s + d + i, s) == table[n, m] and d - i == n - m


def test_common_runs_are_those_of_the_longest_first_recursion(spark):
    rng = random.Random(12)
    rows = []
    for k in range(40):
        words = "abcdefgh"[: rng.randrange(1, 9)]
        a = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        b = [w for w in a[rng.randrange(5) :] if rng.random() > 0.15] if k % 2 else [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        rows.append((k, a, b))
    rows.append((99, ["the"] * 300, ["the"] * 200 + ["end"]))
    long = [f"w{i}" for i in range(2000)]
    rows.append((100, long, long[500:1500]))
    got = {}
    for r in alignment.common_runs(spark.createDataFrame(rows, "_pair long, a array<string>, b array<string>").repartition(3)).collect():
        got.setdefault(r["_pair"], []).append((r.a, r.b, r.n))
    joined = lambda blocks: sorted((a + i, b + i) for a, b, n in blocks for i in range(n))
    for k, a, b in rows:
        want = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        assert joined(got.get(k, [])) == joined(want), k
    assert got[100] == [(500, 0, 1000)]


def test_every_clip_has_a_row(spark):
    refs = spark.createDataFrame([(1, "one two three four five six seven"), (2, "the end"), (3, None)], "ref_id long, ref string")
    clips = spark.createDataFrame([(1, "Two, three"), (2, "END"), (3, "nothing of it here at all"), (4, ""), (5, None), (6, "zero two three four five six ten")], "clip_id long, hyp string")
    got = {(r.clip_id, r.ref_id): r for r in alignment.located_clips(clips, refs).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, None), (4, None), (5, None), (6, 1)}
    assert got[1, 1].span_text == "two three" and got[1, 1].quality == "clean" and got[2, 2].span_text == "end"
    assert got[6, 1].matched_words == 5 and got[6, 1].raw_start == 1
    assert all(got[k, None].error and got[k, None].quality == "unaligned" for k in (3, 4, 5)) and got[3, None].hyp_words == 6


def test_windows_of_short_texts(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, list("abcdef")), (3, [])], "id long, t array<string>")
    own = alignment.shingles(docs, "id", F.col("t"), range(1, 6), own=True).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in own} == {1: 1, 2: 2}
    assert alignment.shingles(docs, "id", F.col("t"), (2, 5)).count() == 1 + 5 + 2


def test_needed_distances_give_the_best_of_all_assignments(spark):
    """Up to five speakers a side against all permutations, with fewer pairs aligned than there are."""
    rng = random.Random(21)
    rows = {"ref": [], "hyp": []}
    for r in range(25):
        voices = [[f"{rng.choice('abcdefgh')}{rng.randrange(4)}" for _ in range(rng.randrange(0, 25))] for _ in range(rng.randrange(1, 6))]
        rows["ref"] += [(f"r{r}", f"s{k}", " ".join(v)) for k, v in enumerate(voices)]
        heard = [[w for w in v if rng.random() > 0.2] for v in voices[: rng.randrange(1, 6)]] + [["uh"]] * rng.randrange(0, 2)
        rng.shuffle(heard)
        rows["hyp"] += [(f"r{r}", f"h{k}", " ".join(v)) for k, v in enumerate(heard)]
    ref, hyp = (spark.createDataFrame(rows[s], "recording_id string, speaker_key string, text string").repartition(3) for s in ("ref", "hyp"))
    got = {r.recording_id: r.errors for r in scoring.speaker_error_rate(ref, hyp, ["recording_id"]).collect()}
    total = 0
    for r in range(25):
        a, b = ([t.split() for k, _, t in rows[s] if k == f"r{r}"] for s in ("ref", "hyp"))
        total += len(a) * len(b)
        n = max(len(a), len(b))
        a, b = a + [[]] * (n - len(a)), b + [[]] * (n - len(b))
        cost = [[table(x, y)[0] for y in b] for x in a]
        assert got[f"r{r}"] == min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
    cells = scoring.needed_distances(ref, hyp, ["recording_id"]).collect()
    assert len(cells) == total
    assert sum(c.errors is not None for c in cells) < 0.6 * total
    assert all(c.least <= c.errors for c in cells if c.errors is not None)


def test_documents_against_the_table(spark, tmp_path):
    """The query over whole documents against a table filled cell by cell."""
    import re

    from parley.catalog import QUERIES

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "C,", "d-e", "[noise]", "ok", "it's", "x"]) for _ in range(n)) for n in (0, 1, 2, 7, 30, 90, 150)] + [None, "", "one\ntwo\tthree " * 25]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def damage(text, mode):
        out = []
        for i, w in enumerate(w for w in re.split("[ \t\n\r]+", text) if w):
            out += [] if mode == 0 and i % 7 == 3 else ["zzz"] if mode == 1 and i % 5 == 2 else [w, w] if mode == 2 and i % 6 == 1 else [w]
        return " ".join(out)

    def normal(text):
        text = re.sub(r"\[[a-z]+\]", " ", text.lower())
        words = re.sub(r"[^a-z'-]+", " ", text).split()
        return ["okay" if w == "ok" else w for w in words]

    found = {r.doc_id: r for r in QUERIES["document_error_rates"](spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        if text is None:
            assert found[k].ref_words == 0 and found[k].wer_normalized is None
            continue
        hyp = damage(text, k % 3)
        (edits, subs), (raw, _) = table(normal(text), normal(hyp)), table(text.split(), hyp.split())
        r = found[k]
        assert (r.errors, r.substitutions, r.raw_errors, r.ref_words, r.hyp_words) == (edits, subs, raw, len(normal(text)), len(normal(hyp))), k


def test_wide_and_narrow_bands_in_one_batch():
    rng = random.Random(31)
    pairs = []
    for _ in range(150):
        a = [rng.randrange(6) for _ in range(rng.randrange(0, 60))]
        b = [w for w in a if rng.random() > rng.choice((0.02, 0.3))] if rng.random() < 0.7 else [rng.randrange(6) for _ in range(rng.randrange(0, 60))]
        pairs.append((a, b))
    for (a, b), (s, d, i) in zip(pairs, distance.batch_counts(pairs).tolist()):
        assert (s + d + i, s) == table(a, b) and len(a) - d + i == len(b)


def test_bounds_leave_little_of_the_table(monkeypatch):
    """Texts that lost, gained or exchanged words are counted without it; what is swapped needs a band of a few diagonals."""
    filled = []
    groups = distance._groups
    monkeypatch.setattr(distance, "_groups", lambda shapes: filled.extend(shapes) or groups(shapes))
    rng = random.Random(77)
    a = [rng.randrange(300) for _ in range(400)]
    lost = [w for i, w in enumerate(a) if i % 7 != 3]
    swapped = [w if i % 5 != 2 else -1 for i, w in enumerate(a)]
    assert distance.batch_counts([(a, lost), (lost, a), (a, swapped)]).tolist() == [[0, 57, 0], [0, 0, 57], [80, 0, 0]]
    assert not filled
    swapped[100:102] = swapped[101], swapped[100]
    (s, d, i), = distance.batch_counts([(a, swapped)]).tolist()
    assert (s + d + i, s) == table(a, swapped)
    assert len(filled) == 1 and filled[0][3] <= 4


def test_windows_are_rows_and_gaps_share_a_batch(spark):
    """Windows are hashed in compiled code, to the number of their slice; gaps come by the batch, not one Python call each."""
    docs = spark.createDataFrame([(1, ["a", None, "c", "d", "e", "f"]), (2, ["x"]), (3, [])], "id long, t array<string>")
    found = alignment.shingles(docs, "id", F.col("t"), (1, 3, 5))
    want = [
        (r.id, p, spark.range(1).select(F.xxhash64(F.array(*[F.lit(w).cast("string") for w in r.t[p : p + n]]), F.lit(n))).first()[0])
        for r in docs.collect() for n in (1, 3, 5) for p in range(len(r.t) - n + 1)
    ]
    assert sorted((r.id, r.pos, r.gram) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "slice(" not in plan
    runs = lambda *r: [np.array(c) for c in zip(*r)]
    gaps = [(4, *runs((3, 0, 0), (2, 2, 5))), (9, *runs((2, 1, 1)))]
    (out,) = alignment._chosen(1)(iter([pd.DataFrame(gaps, columns=["_pair", "n", "a", "b"])]))
    assert sorted(out[["_pair", "a", "b", "n"]].itertuples(index=False, name=None)) == [(4, 0, 0, 3), (4, 3, 6, 1), (9, 1, 1, 2)]
