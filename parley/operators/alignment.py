"""Locating an untimed clip inside a long reference.

Common runs of two token texts are found as rows: windows of 1, 4, 16, ...
tokens are named by hashes built from those of the level below, windows that
occur on both sides meet in a join, and windows one after another on one
diagonal are a run. Levels are worked from the longest down, and each only
inside the gaps that the runs of the levels above have left, so short windows,
of which common words make very many, are joined in small gaps only.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import text
from parley.functions.flow import hold
from parley.operators.ordered import first, islands, rows, time_chunk
from parley.session import dealt, settle

SHINGLE = 5
# Drift allowed around the estimated window.
MIN_MARGIN = 50
MARGIN_PART = 5
# Each level's windows are so many times longer than the next one's.
GROWTH = 4


def shingles(docs: DataFrame, key: str, tokens: Column, n: int | Sequence[int] = SHINGLE, own: bool = False) -> DataFrame:
    """One row per window of tokens: key, pos, gram (a 64-bit hash of the window and its length).

    ``n`` is the window's length, or several. With ``own``, texts have windows
    of one length only: the longest of ``n`` that fits, or all their tokens if
    none does, so that a short text is not without a window.
    """
    sizes = sorted([n] if isinstance(n, int) else set(n))
    toks = hold(docs.select(key, tokens.alias("_t")), "_t").filter(F.size("_t") > 0)
    every = F.array(*[F.lit(k) for k in sizes])
    longest = F.array_max(F.filter(every, lambda k: k <= F.size("_t")))
    lengths = F.array(F.coalesce(longest, F.size("_t"))) if own else F.filter(every, lambda k: k <= F.size("_t"))
    cut = toks.select(key, "_t", F.explode(lengths).alias("_n"))
    at = cut.select(key, "_t", "_n", F.explode(F.sequence(F.lit(0), F.size("_t") - F.col("_n"))).alias("pos"))
    # A row a window, hashed token by token in compiled code: the same number as of the window's slice. NULL past the end changes no hash.
    gram = F.xxhash64(*[F.when(F.col("_n") > j, F.get("_t", F.col("pos") + j)) for j in range(sizes[-1])], "_n")
    return at.select(key, F.col("pos").cast("long").alias("pos"), gram.alias("gram"))


def clip_matches(clips: DataFrame, references: DataFrame) -> DataFrame:
    """Matching runs between clips and references.

    Both inputs are shingle tables (clip_id / ref_id, pos, gram). Shared
    shingles vote for an offset; consecutive votes on one offset are a run.
    Only offsets in use are produced, never all pairs of texts.
    """
    hits = clips.withColumnRenamed("pos", "clip_pos").join(
        references.withColumnRenamed("pos", "ref_pos"), "gram"
    )
    hits = hits.withColumn("offset", F.col("ref_pos") - F.col("clip_pos"))
    return islands(
        hits,
        ["clip_id", "ref_id", "offset"],
        ["clip_pos"],
        time_chunk("clip_pos", 100_000),
        ["clip_pos"],
        lambda prev, cur: cur("clip_pos") > prev("clip_pos") + 1,
        {"clip_start": first("clip_pos"), "ref_start": first("ref_pos"), "grams": rows()},
    )


def best_spans(runs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """The longest run per (clip, reference): earliest in the reference on ties."""
    size = F.col("grams") + (n - 1)
    best = F.max_by(
        F.struct("clip_start", "ref_start", "offset", size.alias("words")),
        F.struct(size, -F.col("ref_start"), -F.col("clip_start")),
    )
    return (
        runs.groupBy("clip_id", "ref_id")
        .agg(best.alias("_b"), F.count(F.lit(1)).alias("runs"))
        .select("clip_id", "ref_id", "runs", "_b.*")
    )


def _chosen(least: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pick runs of each gap, a row of ``_pair`` and its runs as arrays ``n``, ``a`` and ``b``: always the longest that is left, cut to the space between those already picked.

    Of equally long ones the earliest in ``a`` is taken, then the earliest in
    ``b``. What a pick leaves of a crossing run lies on one side of it, as no
    run is longer than the pick; remains shorter than ``least`` wait for the
    next level.
    """

    def pick(sizes: np.ndarray, firsts: np.ndarray, seconds: np.ndarray) -> list[tuple[int, int, int]]:
        heap = [(-n, a, b) for n, a, b in zip(sizes.tolist(), firsts.tolist(), seconds.tolist())]
        heapq.heapify(heap)
        starts: list[int] = []
        picked: list[tuple[int, int, int]] = []
        while heap:
            size, a, b = heapq.heappop(heap)
            n, at = -size, bisect_right(starts, a)
            skip, end = 0, n
            if at:
                x, y, m = picked[at - 1]
                skip = max(0, x + m - a, y + m - b)
            if at < len(picked):
                x, y, _ = picked[at]
                end = min(end, x - a, y - b)
            if end - skip < least:
                continue
            if end - skip < n:
                heapq.heappush(heap, (skip - end, a + skip, b + skip))
                continue
            starts.insert(at, a)
            picked.insert(at, (a, b, n))
        return picked

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for gaps in batches:
            picked = [pick(*runs) for runs in zip(gaps["n"], gaps["a"], gaps["b"])]
            out = pd.DataFrame([p for runs in picked for p in runs], columns=["a", "b", "n"], dtype="int64")
            out.insert(0, "_pair", np.repeat(gaps["_pair"].to_numpy(), [len(runs) for runs in picked]))
            yield out

    return run


def common_runs(pairs: DataFrame) -> DataFrame:
    """Common runs of both token arrays of each row: ``_pair``, ``a``, ``b``, ``n``.

    ``pairs`` has a unique ``_pair`` (long) and the arrays ``a`` and ``b``; it is read
    several times and should be a table. The longest common run is taken
    first, the earliest in ``a`` and then in ``b`` of equally long ones, then
    the longest on either side of it, and so on, until no token is in common.
    Tokens and windows are compared by 64-bit hashes. NULL tokens are not
    expected; empty arrays have no runs.

    A level costs one join of windows and one group per gap, whatever the
    number of runs; there are as many levels as the base-4 logarithm of the
    longest shorter side. A gap's runs, not its texts, are one task's work.
    """
    spark = pairs.sparkSession
    sizes = pairs.select("_pair", F.size("a").cast("long").alias("ahi"), F.size("b").cast("long").alias("bhi")).filter("ahi > 0 and bhi > 0")
    longest = sizes.agg(F.max(F.least("ahi", "bhi"))).first()[0] or 0
    levels = [1]
    while levels[-1] * GROWTH <= longest:
        levels.append(levels[-1] * GROWTH)

    def windows(side: str) -> DataFrame:
        df = pairs.select("_pair", F.transform(side, lambda t: F.xxhash64(t)).alias("g1"))
        for n in levels[1:]:
            below = f"g{n // GROWTH}"
            last = F.size(below) - (GROWTH - 1) * (n // GROWTH)
            parts = lambda i: [F.get(F.col(below), i + k * (n // GROWTH)) for k in range(GROWTH)]  # noqa: B023, E731
            made = F.when(last > 0, F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(*parts(i)))).otherwise(F.array().cast("array<bigint>"))
            df = hold(df.withColumn(f"g{n}", made), f"g{n}")
        return settle(spark, df, "windows")

    both = {side: windows(side) for side in ("a", "b")}
    whole = sizes.select("_pair", F.lit(0).cast("long").alias("alo"), "ahi", F.lit(0).cast("long").alias("blo"), "bhi")
    found, gaps = None, whole
    for n in reversed(levels):
        fits = gaps.filter((F.col("ahi") - F.col("alo") >= n) & (F.col("bhi") - F.col("blo") >= n))

        def inside(side: str) -> DataFrame:
            lo, hi = F.col(f"{side}lo"), F.col(f"{side}hi")
            part = F.slice(f"g{n}", (lo + 1).cast("int"), (hi - lo - n + 1).cast("int"))  # noqa: B023
            met = fits.join(both[side].select("_pair", f"g{n}"), "_pair")  # noqa: B023
            return met.select("_pair", "alo", "blo", lo.alias("_lo"), F.posexplode(part).alias("_at", "gram")).select(
                "_pair", "alo", "blo", (F.col("_lo") + F.col("_at")).alias(side), "gram"
            )

        gap = ["_pair", "alo", "blo"]
        hits = inside("a").join(inside("b"), [*gap, "gram"]).withColumn("shift", F.col("a") - F.col("b"))
        along = W.partitionBy(*gap, "shift").orderBy("a")
        runs = (
            hits.withColumn("_run", F.col("a") - F.row_number().over(along))
            .groupBy(*gap, "shift", "_run")
            .agg(F.min("a").alias("a"), F.min("b").alias("b"), (F.count("*") + (n - 1)).alias("n"))
        )
        # Dealt, as a gap is far more work than its bytes tell.
        gathered = dealt(runs, *gap).groupBy(*gap).agg(F.collect_list(F.struct("n", "a", "b")).alias("_runs"))
        picked = gathered.select("_pair", "_runs.n", "_runs.a", "_runs.b").mapInPandas(_chosen(n), "_pair long, a long, b long, n long")
        found = settle(spark, picked if found is None else found.unionByName(picked), "runs")
        gaps = _gaps(found, whole)
    return found


def _gaps(found: DataFrame, whole: DataFrame) -> DataFrame:
    """The spaces before, between and behind the runs of each pair that are empty on no side."""
    end = F.struct((F.col("a") + F.col("n")).alias("a"), (F.col("b") + F.col("n")).alias("b"))
    before = F.lag(end).over(W.partitionBy("_pair").orderBy("a"))
    zero = F.lit(0).cast("long")
    between = found.withColumn("_p", before).select(
        "_pair", F.coalesce("_p.a", zero).alias("alo"), F.col("a").alias("ahi"), F.coalesce("_p.b", zero).alias("blo"), F.col("b").alias("bhi")
    )
    last = found.groupBy("_pair").agg(F.max_by(end, "a").alias("_e"))
    behind = whole.join(last, "_pair", "left").select(
        "_pair", F.coalesce("_e.a", zero).alias("alo"), "ahi", F.coalesce("_e.b", zero).alias("blo"), "bhi"
    )
    return between.unionByName(behind).filter("alo < ahi and blo < bhi")


def align_clips(pairs: DataFrame, composed: bool = False) -> DataFrame:
    """Reference span of each (ref, hyp) row, in raw reference words.

    The longest common run fixes the offset. Runs that start inside the
    clip-long window at that offset (plus a margin) count as matched, and the
    span goes from the first to the last of them. Tokens are normalized one by
    one, so a raw token can give none or several words that point back at it.
    Every row stays: without a common word the error says so. A NULL text is
    an empty one.
    """
    words_of = lambda w, i: F.transform(
        text.normal_tokens(w, True), lambda n: F.struct(n.alias("word"), i.cast("long").alias("at"))
    )
    ref = F.col("ref") if composed else text.nfc(F.col("ref"))
    split = hold(
        pairs.withColumn("_raw", text.raw_tokens(ref)).withColumn(
            "_hyp", text.normal_tokens(F.col("hyp"), composed)
        ),
        "_raw",
        "_hyp",
    )
    mapped = hold(split.withColumn("_ref", F.flatten(F.transform("_raw", words_of))), "_ref")
    table = settle(pairs.sparkSession, mapped.withColumn("_pair", F.monotonically_increasing_id()), "clips")
    found = common_runs(table.select("_pair", F.col("_ref.word").alias("a"), F.col("_hyp").alias("b")))
    blocks = found.groupBy("_pair").agg(F.array_sort(F.collect_list(F.struct("a", "b", "n"))).alias("_blocks"))
    tok = table.join(blocks, "_pair", "left").withColumn("_blocks", F.coalesce("_blocks", F.array().cast("array<struct<a:bigint,b:bigint,n:bigint>>")))
    size, clip = F.size("_ref").cast("long"), F.size("_hyp").cast("long")
    longest = F.array_max(
        F.transform("_blocks", lambda x: F.struct(x["n"].alias("n"), -x["a"], (x["a"] - x["b"]).alias("shift")))
    )
    low = F.greatest(F.col("_longest.shift"), F.lit(0))
    margin = F.greatest(F.floor(clip / MARGIN_PART), F.lit(MIN_MARGIN))
    high = F.least(size, low + clip)
    inside = F.filter(
        "_blocks", lambda x: (x["a"] >= low - margin) & (x["a"] < high + margin)
    )
    used = hold(hold(tok.withColumn("_longest", longest), "_longest").withColumn("_in", inside), "_in")
    at = lambda pos: F.col("_ref.at")[pos.cast("int")]
    spans = (
        used.withColumn("ref_words_total", size)
        .withColumn("hyp_words", clip)
        .withColumn(
            "matched_words",
            F.when(F.size("_in") > 0, F.aggregate("_in", F.lit(0).cast("long"), lambda s, x: s + x["n"])),
        )
        .withColumn("coverage", F.round(F.col("matched_words") / F.greatest(clip, F.lit(1)), 4))
        .withColumn("raw_start", F.when(F.size("_in") > 0, at(F.try_element_at("_in", F.lit(1))["a"])))
        .withColumn(
            "raw_end",
            F.when(
                F.size("_in") > 0,
                at(F.try_element_at("_in", F.lit(-1))["a"] + F.try_element_at("_in", F.lit(-1))["n"] - 1),
            ),
        )
        .withColumn("ref_span_words", F.col("raw_end") - F.col("raw_start") + 1)
    )
    span_text = F.when(
        F.col("raw_start").isNotNull(),
        F.array_join(
            F.slice("_raw", (F.col("raw_start") + 1).cast("int"), F.col("ref_span_words").cast("int")), " "
        ),
    )
    error = F.when(F.col("matched_words").isNull(), "no alignment between hypothesis and reference")
    return spans.select(
        *[c for c in pairs.columns if c not in ("ref", "hyp")],
        "ref_words_total",
        "hyp_words",
        "matched_words",
        "coverage",
        "raw_start",
        "raw_end",
        "ref_span_words",
        span_text.alias("span_text"),
        error.alias("error"),
    )


def coverage_class(coverage: Column) -> Column:
    """Fixed bounds: above 0.9 clean, below 0.85 suspect."""
    return (
        F.when(coverage.isNull(), "unaligned")
        .when(coverage > 0.9, "clean")
        .when(coverage < 0.85, "suspect")
        .otherwise("borderline")
    )


def located_clips(clips: DataFrame, references: DataFrame) -> DataFrame:
    """Each clip in every reference that shares a window with it, with its quality.

    ``clips`` has clip_id and hyp, ``references`` ref_id and ref. Windows have
    SHINGLE tokens; a shorter clip is one window of all its tokens. A clip that
    shares none has one row without a reference and with an error text.
    """
    spark = clips.sparkSession
    windows = shingles(clips, "clip_id", text.normal_tokens(F.col("hyp")), range(1, SHINGLE + 1), own=True)
    least = F.least(F.size(text.normal_tokens(F.col("hyp"))), F.lit(SHINGLE))
    sizes = [r[0] for r in clips.select(least).distinct().collect() if r[0]]  # at most SHINGLE of them
    known = shingles(references, "ref_id", text.normal_tokens(F.col("ref")), sizes or SHINGLE)
    met = settle(spark, windows.select("clip_id", "gram").join(known.select("ref_id", "gram"), "gram").select("clip_id", "ref_id").distinct(), "met")
    found = align_clips(met.join(clips, "clip_id").join(references, "ref_id"))
    lone = clips.join(met, "clip_id", "left_anti").withColumn("ref_id", F.lit(None).cast(references.schema["ref_id"].dataType))
    nothing = lone.select(
        *[F.size(text.normal_tokens(F.col("hyp"))).cast("long").alias(c) if c == "hyp_words" else F.col(c) if c in ("clip_id", "ref_id")
          else F.lit("no alignment between hypothesis and reference").alias(c) if c == "error"
          else F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns]
    )
    return found.unionByName(nothing).withColumn("quality", coverage_class(F.col("coverage")))
