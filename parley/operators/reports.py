"""Sweep reports.

results: run, fixture, fixture_ord, ok, wer_norm, wer_raw, peak_rss_mb,
asr_ms, flags (JSON text), and for echo runs erle struct<...>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ordered import scan_before

MISSING_RANK = -99.0


def scored_rows(results: DataFrame) -> DataFrame:
    """Rows that say they are ok; an absent flag is a failure."""
    return results.filter(F.coalesce(F.col("ok"), F.lit(False)))


def pending_cells(runs: DataFrame, fixtures: DataFrame, done: DataFrame) -> DataFrame:
    """Grid cells without a result row, failed ones included as done.

    The grid is the product of two small name lists by definition.
    """
    grid = runs.select("run").crossJoin(fixtures.select("fixture"))
    return grid.join(done.select("run", "fixture"), ["run", "fixture"], "left_anti")


def run_means(results: DataFrame) -> DataFrame:
    """Means over fixtures and the flags of the first one, best rate first."""
    return (
        scored_rows(results)
        .groupBy("run")
        .agg(
            F.avg("wer_norm").alias("wer"),
            F.avg("peak_rss_mb").alias("rss_mb"),
            F.avg("asr_ms").alias("asr_ms"),
            F.min_by("flags", "fixture_ord").alias("flags"),
            F.count(F.lit(1)).alias("fixtures"),
        )
        .orderBy("wer", "run")
    )


def baseline_delta(means: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Difference of each run's rate to the baseline's; 0 stands for a missing one."""
    base = means.agg(F.max(F.when(F.col("run") == baseline, F.col("wer"))).alias("_b"))
    # One aggregate row by construction.
    return means.crossJoin(F.broadcast(base)).withColumn(
        "delta_wer", F.col("wer") - F.coalesce("_b", F.lit(0.0))
    ).drop("_b")


def pareto_front(points: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Points with no other distinct point at most as great in both.

    No self-join: a point is beaten by the least ``y`` among smaller ``x``, or
    by a smaller ``y`` at its own ``x``. The running minimum goes over cells of
    width ``cell`` first and then inside one cell.
    """
    low = points.groupBy(F.col(x).alias("_x")).agg(F.min(y).alias("_y")).withColumn(
        "_cell", F.floor(F.col("_x") / cell)
    )
    coarse = scan_before(low.groupBy("_cell").agg(F.min("_y").alias("_cy")), "_cell", "_cy", "min", "_carry").drop("_cy")
    inside = Window.partitionBy("_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    marks = low.join(coarse, "_cell").select(
        F.col("_x").alias(x), "_y", F.least(F.min("_y").over(inside), F.col("_carry")).alias("_left")
    )
    return (
        points.join(marks, x)
        .filter((F.col(y) == F.col("_y")) & (F.col("_left").isNull() | (F.col("_left") > F.col(y))))
        .drop("_y", "_left")
    )


def echo_table(results: DataFrame) -> DataFrame:
    """Echo metrics by run; missing or zero ratios rank last."""
    at = lambda fixture, field: F.max(F.when(F.col("fixture") == fixture, F.col(f"erle.{field}")))
    t = (
        scored_rows(results)
        .groupBy("run")
        .agg(
            at("echoonly", "erle_db").alias("echo_only_erle"),
            at("doubletalk", "erle_db").alias("double_talk_erle"),
            at("doubletalk", "near_seg_snr_db").alias("double_talk_snr"),
            at("doubletalk", "near_correlation").alias("double_talk_corr"),
        )
    )
    eo = F.col("echo_only_erle")
    key = F.when(eo.isNull() | (eo == 0), MISSING_RANK).otherwise(eo)
    return t.withColumn("rank_key", key).orderBy(F.col("rank_key").desc(), "run")


def speaker_table(results: DataFrame) -> DataFrame:
    c = F.col("cpwer")
    return scored_rows(results).select(
        "run",
        "fixture",
        c["cpwer"].alias("cpwer"),
        c["ref_speakers"].alias("ref_speakers"),
        c["hyp_speakers"].alias("hyp_speakers"),
        c["speaker_count_error"].alias("speaker_count_error"),
        F.coalesce("peak_rss_mb", F.lit(0.0)).alias("rss_mb"),
        "flags",
    )


def engine_comparison(rows: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Two engines over alternating iterations: one row per fixture."""
    of = lambda e, c: F.avg(F.when(F.col("engine") == e, F.col(c)))
    g = rows.groupBy("fixture").agg(
        of(baseline, "asr_ms").alias("base_ms"),
        of(candidate, "asr_ms").alias("cand_ms"),
        of(baseline, "peak_rss_bytes").alias("base_rss"),
        of(candidate, "peak_rss_bytes").alias("cand_rss"),
        of(baseline, "wer_normalized").alias("base_wer"),
        of(candidate, "wer_normalized").alias("cand_wer"),
    )
    return g.select(
        "fixture",
        "base_ms",
        "cand_ms",
        F.when(F.col("cand_ms") > 0, F.col("base_ms") / F.col("cand_ms")).alias("speedup"),
        F.when(F.col("base_rss") > 0, (F.col("cand_rss") - F.col("base_rss")) / F.col("base_rss")).alias("rss_change"),
        F.abs(F.col("base_wer") - F.col("cand_wer")).alias("wer_gap"),
    )


def artifact_catalog(catalog: DataFrame, engine: str, embedding: str) -> DataFrame:
    """Catalog rows one configuration needs.

    catalog: id, asr_engine (NULL = any), is_embedding.
    """
    return catalog.filter(
        (F.col("asr_engine").isNull() | (F.col("asr_engine") == engine))
        & (~F.col("is_embedding") | (F.col("id") == embedding))
    )


def stage_timing(stages: DataFrame) -> DataFrame:
    """Duration statistics per (stage, backend)."""
    return stages.groupBy("stage", "backend").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("duration_ms").alias("mean_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.percentile_approx("duration_ms", 0.5, 10_000).alias("median_ms"),
    )


# Diagram boxes in order, and the stage ids that light each.
BOXES = [
    ("detect", ["recording"]),
    ("capture", ["recording"]),
    ("echo", ["cancelling_echo", "transcribing"]),
    ("transcribe", ["transcribing"]),
    ("file", ["filing"]),
]


def active_boxes(stage: Column, recording: Column) -> Column:
    """Active diagram boxes in fixed order; recording always adds its two."""
    lit = [
        F.when(
            stage.isin(*stages) | (recording & F.lit("recording" in stages)), F.lit(box)
        )
        for box, stages in BOXES
    ]
    return F.filter(F.array(*lit), lambda b: b.isNotNull())
