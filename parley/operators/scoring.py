"""Word error rate, per-speaker error rate and transcript collapsing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from parley.functions import distance, text
from parley.functions.flow import hold
from parley.operators.ordered import in_order, row_chunk
from parley.session import settle

PART_SECS = 3600.0
PART_TURNS = 10_000


def transcript_text(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each transcript in (start, end) order, list order breaking ties.

    Hours are joined first, so that sorting a very long transcript is spread
    and its last step only concatenates a few hour texts.
    """
    start = F.coalesce("start", F.lit(0.0))
    at = F.struct(start, F.coalesce("end", F.lit(0.0)), F.col("seq"))
    return _joined_parts(segments, keys, F.floor(start / PART_SECS), at)


def _joined_parts(rows: DataFrame, keys: list[str], part: Column, at: Column) -> DataFrame:
    body = in_order(F.coalesce("text", F.lit("")), at)
    parts = rows.groupBy(*keys, part.alias("_part")).agg(F.array_join(body, " ").alias("text"))
    return parts.groupBy(*keys).agg(F.array_join(in_order(F.col("text"), F.col("_part")), " ").alias("text"))


def speaker_text(segments: DataFrame, keys: list[str], composed: bool = False) -> DataFrame:
    """Normalized text per hypothesis speaker, keyed ``kind:label``."""
    key = F.concat_ws(":", F.coalesce("speaker.kind", F.lit("")), F.coalesce("speaker.label", F.lit("")))
    named = segments.withColumn("speaker_key", key)
    out = transcript_text(named, [*keys, "speaker_key"])
    return out.withColumn("text", text.normalize(F.col("text"), composed))


def reference_speaker_text(turns: DataFrame, keys: list[str], composed: bool = False) -> DataFrame:
    """Normalized text per reference speaker in turn order."""
    named = turns.withColumn("speaker_key", F.col("speaker"))
    out = _joined_parts(named, [*keys, "speaker_key"], row_chunk("seq", PART_TURNS), F.col("seq"))
    return out.withColumn("text", text.normalize(F.col("text"), composed))


def rate(errors: Column, words: Column) -> Column:
    """Errors per reference word; NULL without reference words."""
    return F.when(words > 0, errors / words)


def word_error_rates(pairs: DataFrame, composed: bool = False, details: bool = True) -> DataFrame:
    """Normalized and raw word error rates of (ref, hyp) rows."""
    tok = hold(
        pairs.withColumn("_r", text.normalize(F.col("ref"), composed))
        .withColumn("_h", text.normalize(F.col("hyp"), composed))
        .withColumn("_rr", text.collapse(F.col("ref")))
        .withColumn("_rh", text.collapse(F.col("hyp"))),
        "_r",
        "_h",
        "_rr",
        "_rh",
    )
    out = tok.withColumn("ref_words", distance.words(F.col("_r"))).withColumn("hyp_words", distance.words(F.col("_h")))
    if details:
        out = (
            out.withColumn("_c", distance.counts(F.col("_r"), F.col("_h")))
            .withColumn("substitutions", F.col("_c.substitutions"))
            .withColumn("deletions", F.col("_c.deletions"))
            .withColumn("insertions", F.col("_c.insertions"))
            .withColumn("errors", F.col("substitutions") + F.col("deletions") + F.col("insertions"))
            .drop("_c")
        )
    else:
        out = out.withColumn("errors", distance.token_distance(F.col("_r"), F.col("_h")))
    return (
        out.withColumn("raw_errors", distance.token_distance(F.col("_rr"), F.col("_rh")))
        .withColumn("wer_normalized", rate(F.col("errors"), F.col("ref_words")))
        .withColumn("wer_raw", rate(F.col("raw_errors"), distance.words(F.col("_rr"))))
        .drop("_r", "_h", "_rr", "_rh")
    )


def pooled_error_rate(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of per-fixture rates, with the pooled rate beside it."""
    return scored.groupBy(*keys).agg(
        F.avg("wer_normalized").alias("mean_wer"),
        rate(F.sum("errors"), F.sum("ref_words")).alias("pooled_wer"),
        F.count(F.lit(1)).alias("fixtures"),
    )


def speaker_counts(ref: DataFrame, hyp: DataFrame, keys: list[str]) -> DataFrame:
    """Speaker counts on both sides and the signed difference.

    Inputs hold one row per (keys, speaker_key).
    """
    r = ref.groupBy(*keys).agg(F.count(F.lit(1)).alias("ref_speakers"))
    h = hyp.groupBy(*keys).agg(F.count(F.lit(1)).alias("hyp_speakers"))
    both = r.join(h, keys, "full").fillna(0, ["ref_speakers", "hyp_speakers"])
    return both.withColumn("speaker_count_error", F.col("hyp_speakers") - F.col("ref_speakers"))


def speaker_distances(ref: DataFrame, hyp: DataFrame, keys: list[str]) -> DataFrame:
    """Edit distance of every reference speaker to every hypothesis speaker.

    The number of rows per recording is the product of both speaker counts.
    Pairs are dealt to tasks one by one, so a recording of many speakers is
    many tasks' work.
    """
    pairs = ref.select(*keys, F.col("speaker_key").alias("ref_key"), F.col("text").alias("_r")).join(
        hyp.select(*keys, F.col("speaker_key").alias("hyp_key"), F.col("text").alias("_h")), keys
    )
    return pairs.repartition(*keys, "ref_key", "hyp_key").select(
        *keys,
        "ref_key",
        "hyp_key",
        distance.words(F.col("_r")).alias("ref_words"),
        distance.words(F.col("_h")).alias("hyp_words"),
        distance.token_distance(F.col("_r"), F.col("_h")).alias("errors"),
    )


def assignment(cost: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Cheapest one-to-one assignment in a square matrix: the column of each row, and the prices of rows and columns.

    Shortest augmenting paths. No cell costs less than its row's and column's
    price together, and cells of the assignment cost just that.
    """
    n = len(cost)
    row_of, u, v = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        best, seen, back = [float("inf")] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while True:
            seen[j] = True
            r, step, nxt = row_of[j], float("inf"), 0
            for k in range(1, n + 1):
                if seen[k]:
                    continue
                slack = cost[r - 1][k - 1] - u[r] - v[k]
                if slack < best[k]:
                    best[k], back[k] = slack, j
                if best[k] < step:
                    step, nxt = best[k], k
            for k in range(n + 1):
                if seen[k]:
                    u[row_of[k]] += step
                    v[k] -= step
                else:
                    best[k] -= step
            j = nxt
            if row_of[j] == 0:
                break
        while j:
            row_of[j], j = row_of[back[j]], back[j]
    column = [0] * n
    for k in range(1, n + 1):
        column[row_of[k] - 1] = k - 1
    return column, u[1:], v[1:]


def best_assignment(cost: list[list[int]]) -> int:
    """Least total cost of a one-to-one assignment in a square matrix."""
    return sum(row[k] for row, k in zip(cost, assignment(cost)[0]))


def _matrix(cells: list) -> tuple[list[list[int]], dict[tuple[int, int], object]]:
    """Costs of a recording's speakers against each other, and the cell behind each entry; an unmatched speaker costs all of its words."""
    refs, hyps = {}, {}
    for c in cells:
        refs.setdefault(c["ref_key"], (len(refs), c["ref_words"]))
        hyps.setdefault(c["hyp_key"], (len(hyps), c["hyp_words"]))
    n = max(len(refs), len(hyps))
    cost = [[0] * n for _ in range(n)]
    for i, words in refs.values():
        cost[i][len(hyps) :] = [words] * (n - len(hyps))
    for j, words in hyps.values():
        for i in range(len(refs), n):
            cost[i][j] = words
    at = {}
    for c in cells:
        i, j = refs[c["ref_key"]][0], hyps[c["hyp_key"]][0]
        cost[i][j] = c["least"] if c["errors"] is None else c["errors"]
        at[i, j] = c
    return cost, at


_PAIRS = ArrayType(StructType().add("ref_key", StringType()).add("hyp_key", StringType()))


def _pair(cell) -> dict:
    return {"ref_key": cell["ref_key"], "hyp_key": cell["hyp_key"]}


@F.pandas_udf(_PAIRS)
def _promising(cells: pd.Series) -> pd.Series:
    """Pairs of the assignment that is cheapest by what the pairs cost at least."""
    out = []
    for rows in cells:
        cost, at = _matrix(list(rows))
        out.append([_pair(at[ij]) for ij in enumerate(assignment(cost)[0]) if ij in at])
    return pd.Series(out)


@F.pandas_udf(_PAIRS)
def _possible(cells: pd.Series) -> pd.Series:
    """Pairs without a known distance that may still be in a cheaper assignment than the best of known ones."""
    out = []
    for rows in cells:
        rows = list(rows)
        cost, at = _matrix(rows)
        known, _ = _matrix([c if c["errors"] is not None else {**_pair(c), "ref_words": c["ref_words"], "hyp_words": c["hyp_words"], "least": c["ref_words"] + c["hyp_words"], "errors": None} for c in rows])
        bound = best_assignment(known)
        column, u, v = assignment(cost)
        least = sum(row[k] for row, k in zip(cost, column))
        out.append([_pair(c) for (i, j), c in at.items() if c["errors"] is None and least + cost[i][j] - u[i] - v[j] < bound])
    return pd.Series(out)


@F.pandas_udf(LongType())
def _assign(cells: pd.Series) -> pd.Series:
    """Total errors per recording from its speaker pairs; those without a distance are in no cheapest assignment."""
    out = []
    for rows in cells:
        cost, _ = _matrix([{**_pair(c), "ref_words": c["ref_words"], "hyp_words": c["hyp_words"], "least": c["ref_words"] + c["hyp_words"], "errors": c["errors"]} for c in list(rows)])
        out.append(best_assignment(cost))
    return pd.Series(out, dtype="Int64")


def speaker_bounds(ref: DataFrame, hyp: DataFrame, keys: list[str]) -> DataFrame:
    """What every pair of speakers of a recording costs at least: keys, ref_key, hyp_key, ref_words, hyp_words, least.

    Words that both have, counted as often as both have them, are all that an
    alignment can keep. Counts of words meet by a join; texts do not.
    """

    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        named = df.select(*keys, F.col("speaker_key").alias(f"{name}_key"), "text")
        words = named.select(*keys, f"{name}_key", F.explode(F.split("text", " ")).alias("_w")).filter("_w <> ''")
        return named.select(*keys, f"{name}_key", distance.words(F.col("text")).alias(f"{name}_words")), words.groupBy(*keys, f"{name}_key", "_w").agg(
            F.count("*").alias(f"_{name}_n")
        )

    (refs, ref_bags), (hyps, hyp_bags) = side(ref, "ref"), side(hyp, "hyp")
    shared = ref_bags.join(hyp_bags, [*keys, "_w"]).groupBy(*keys, "ref_key", "hyp_key").agg(F.sum(F.least("_ref_n", "_hyp_n")).alias("_s"))
    cells = refs.join(hyps, keys).join(shared, [*keys, "ref_key", "hyp_key"], "left")
    least = F.greatest("ref_words", "hyp_words") - F.coalesce("_s", F.lit(0))
    return cells.select(*keys, "ref_key", "hyp_key", "ref_words", "hyp_words", least.alias("least"))


def needed_distances(ref: DataFrame, hyp: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of speakers with their bounds, and ``errors`` for those that the best assignment can need.

    First the pairs of the assignment that is cheapest by the lower bounds are
    aligned; their total is a bound from above. By the prices of the bounded
    assignment, a pair that cannot be part of a cheaper one is left out; the
    others are aligned too. Distances of a recording of many speakers are
    dealt to tasks pair by pair.
    """
    spark = ref.sparkSession
    pair = [*keys, "ref_key", "hyp_key"]
    cell = F.struct("ref_key", "hyp_key", "ref_words", "hyp_words", "least", "errors")
    texts = [d.select(*keys, F.col("speaker_key").alias(f"{n}_key"), F.col("text").alias(f"_{n}")) for d, n in ((ref, "ref"), (hyp, "hyp"))]

    def aligned(cells: DataFrame, choose) -> DataFrame:
        wanted = cells.groupBy(*keys).agg(F.collect_list(cell).alias("_cells")).select(*keys, F.explode(choose("_cells")).alias("_p"))
        wanted = wanted.select(*keys, "_p.ref_key", "_p.hyp_key")
        both = wanted.join(texts[0], [*keys, "ref_key"]).join(texts[1], [*keys, "hyp_key"]).repartition(*pair)
        found = settle(spark, both.select(*pair, distance.token_distance(F.col("_ref"), F.col("_hyp")).alias("_found")), "distances")
        return cells.join(found, pair, "left").withColumn("errors", F.coalesce("errors", "_found")).drop("_found")

    bounds = settle(spark, speaker_bounds(ref, hyp, keys).withColumn("errors", F.lit(None).cast("long")), "bounds")
    return aligned(aligned(bounds, _promising), _possible)


def speaker_error_rate(
    ref: DataFrame, hyp: DataFrame, keys: list[str], max_speakers: int | None = None
) -> DataFrame:
    """Error rate under the best speaker assignment.

    All recordings are scored, and only pairs of speakers that the assignment
    can need are aligned (``needed_distances``). With ``max_speakers``, those with more speakers
    on a side get NULL and a note instead, and their pairs are not built. A
    side without speakers leaves all words of the other as errors.
    """
    side = lambda d, name: d.select(*keys, F.lit(name).alias("_side"), distance.words(F.col("text")).alias("_words"))
    of = lambda name, value: F.when(F.col("_side") == name, value)
    totals = (
        side(ref, "ref")
        .unionByName(side(hyp, "hyp"))
        .groupBy(*keys)
        .agg(
            F.count(of("ref", 1)).alias("ref_speakers"),
            F.count(of("hyp", 1)).alias("hyp_speakers"),
            F.sum(of("ref", F.col("_words"))).alias("_ref_words"),
            F.sum(of("hyp", F.col("_words"))).alias("_hyp_words"),
        )
    )
    most = F.greatest("ref_speakers", "hyp_speakers")
    fits = F.lit(True) if max_speakers is None else most <= max_speakers
    # Texts are read for the bounds and twice for distances.
    ref, hyp = (settle(d.sparkSession, d.select(*keys, "speaker_key", F.coalesce("text", F.lit("")).alias("text")), "speakers") for d in (ref, hyp))
    if max_speakers is not None:
        ref = ref.join(totals.filter(fits).select(*keys), keys, "left_semi")
    per_call = needed_distances(ref, hyp, keys).groupBy(*keys).agg(
        F.collect_list(F.struct("ref_key", "hyp_key", "ref_words", "hyp_words", "errors")).alias("_cells")
    )
    scored = totals.join(per_call.select(*keys, _assign("_cells").alias("_errors")), keys, "left")
    one_sided = F.coalesce("_ref_words", F.lit(0)) + F.coalesce("_hyp_words", F.lit(0))
    note = F.concat(
        F.lit("too many speakers: hyp "),
        F.col("hyp_speakers").cast("string"),
        F.lit(" vs "),
        F.col("ref_speakers").cast("string"),
        F.lit(" ref"),
    )
    return scored.select(
        *keys,
        "ref_speakers",
        "hyp_speakers",
        (F.col("hyp_speakers") - F.col("ref_speakers")).alias("speaker_count_error"),
        F.when(fits, F.coalesce("_errors", one_sided)).alias("errors"),
        F.when(fits, F.col("_ref_words")).alias("ref_words"),
        F.when(~fits, note).alias("note"),
    ).withColumn("cpwer", rate(F.col("errors"), F.col("ref_words")))
