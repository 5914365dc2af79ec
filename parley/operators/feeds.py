"""Bounded views over unbounded feeds: live lines, logs, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import maths, text
from parley.operators.ordered import scan_before, running_total

# The published caps.
LINE_LIMIT = 2000
BYTE_LIMIT = 1024 * 1024
LINE_OVERHEAD = 64
SPEAKER_BYTES = 64
LOG_BYTES = 10 * 1024 * 1024
SNAPSHOT_LIMIT = 300
STAGE_LIMIT = 512


def line_cost() -> Column:
    return F.lit(LINE_OVERHEAD) + F.octet_length("speaker") + F.octet_length("text")


def live_lines(segments: DataFrame) -> DataFrame:
    """Display rows of segments: capped text, clean times, named speakers.

    segments: session_id, seq, speaker (display name), start, end, text.
    """
    body = text.cap_bytes(F.trim("text"), BYTE_LIMIT // 2)
    s = maths.finite_nonnegative(F.col("start"))
    who = F.coalesce("speaker", F.lit(""))
    return segments.select(
        "session_id",
        "seq",
        F.when(who.isin("", "Them"), "Them 1").otherwise(text.cap_bytes(who, SPEAKER_BYTES)).alias("speaker"),
        s.alias("start"),
        F.greatest(maths.finite_nonnegative(F.col("end")), s).alias("end"),
        body.alias("text"),
    ).filter(F.col("text") != "")


def retained_lines(lines: DataFrame, max_lines: int = LINE_LIMIT, max_bytes: int = BYTE_LIMIT) -> DataFrame:
    """The newest lines of each session within both caps.

    The line cap is a rank filter that Spark also applies before the shuffle,
    so a hot session sends at most ``max_lines`` rows per task.
    """
    newest = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    near = lines.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= max_lines)
    used = F.sum(line_cost()).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("_used", used).filter(F.col("_used") <= max_bytes).drop("_rn", "_used")


def retention_state(lines: DataFrame, max_lines: int = LINE_LIMIT, max_bytes: int = BYTE_LIMIT) -> DataFrame:
    """Evicted count and first retained seq per session."""
    seen = lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("_all"), F.max("seq").alias("_last"))
    kept = retained_lines(lines, max_lines, max_bytes).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("retained_lines"), F.min("seq").alias("_from")
    )
    return seen.join(kept, "session_id", "left").select(
        "session_id",
        F.coalesce("retained_lines", F.lit(0)).alias("retained_lines"),
        (F.col("_all") - F.coalesce("retained_lines", F.lit(0))).alias("evicted_lines"),
        F.coalesce("_from", F.col("_last") + 1).alias("retained_from_seq"),
    )


def log_line() -> Column:
    return F.format_string("%s %s %s: %s", "timestamp", "level", "target", "message")


def log_message(message: Column, fields: Column) -> Column:
    """Explicit message, else ``k=v`` pairs of the event's fields."""
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.coalesce(message, F.array_join(pairs, " "))


def search_logs(logs: DataFrame, levels: list[str], needle: str) -> DataFrame:
    out = logs.filter(F.col("level").isin(*levels))
    return out.filter(F.contains(F.lower(log_line()), F.lit(needle.lower()))) if needle else out


def log_cost() -> Column:
    parts = ["timestamp", "level", "target", "message"]
    cost = F.lit(0)
    for p in parts:
        cost = cost + F.coalesce(F.octet_length(p), F.lit(0))
    return cost.cast("long")


def recent_logs(logs: DataFrame, span: int, max_bytes: int = LOG_BYTES) -> DataFrame:
    """Newest log entries within a byte budget.

    logs need ``at`` (a numeric clock) and ``ord``. Blocks of ``span`` clock
    units are totalled first; blocks wholly past the budget never reach the
    per-entry sum, so at most one block more than the budget is read.
    ``span`` should be short enough for a block to fit a task. A NULL field
    has no bytes; entries without a clock come last.
    """
    at = F.coalesce(F.col("at"), F.lit(-(2**62)))
    keyed = logs.withColumn("_blk", -F.floor(at / span))
    blocks = keyed.groupBy("_blk").agg(F.sum(log_cost()).alias("_b"))
    used = F.coalesce("_before", F.lit(0)).alias("_used")
    live = scan_before(blocks, "_blk", "_b", "sum", "_before").select("_blk", used).filter(F.col("_used") < max_bytes)
    # The blocks within the budget, each with what is newer: a block is one task's work.
    near = keyed.join(live, "_blk")
    along = Window.partitionBy("_blk").orderBy(F.col("at").desc(), F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = near.withColumn("_sum", F.col("_used") + F.sum(log_cost()).over(along))
    return summed.filter(F.col("_sum") <= max_bytes).drop("_blk", "_used", "_sum")


def newest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows, newest first."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def newest_per_key(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def shown_threads(threads: DataFrame, prefix: str, others: int = 8) -> DataFrame:
    """All threads with the prefix by load, then the busiest others.

    threads: snapshot_id, name, cpu_pct.
    """
    own = F.col("name").startswith(prefix)
    ours = threads.filter(own).withColumn("class", F.lit(0))
    rest = newest_per_key(threads.filter(~own), "snapshot_id", ["cpu_pct", "name"], others)
    return ours.unionByName(rest.withColumn("class", F.lit(1)))


def reconcile(events: DataFrame) -> DataFrame:
    """Current lines per feed from snapshot and delta events.

    events: feed_id, revision, session_id, reset, retained_from_seq, line
    struct<seq,start,end,speaker,text>. Stale revisions change nothing, a reset
    or a new session clears the rows, a repeated seq keeps its latest line.
    """
    e = events
    # The last reset or session switch bounds what is alive.
    current = e.groupBy("feed_id").agg(
        F.max_by(F.struct("session_id", "retained_from_seq"), "revision").alias("_now"),
        F.max("revision").alias("revision"),
    )
    # A session is one run of revisions, so it starts at its latest reset,
    # else at its first revision after any other session.
    s = e.join(
        current.select("feed_id", F.col("_now.session_id").alias("_sid"), F.col("_now.retained_from_seq").alias("_keep"), F.col("revision").alias("_rev")),
        "feed_id",
    )
    mine = F.col("session_id").eqNullSafe(F.col("_sid"))
    bounds = s.groupBy("feed_id").agg(
        F.max(F.when(~mine, F.col("revision"))).alias("_other"),
        F.max(F.when(mine & F.col("reset"), F.col("revision"))).alias("_reset"),
    )
    alive = s.join(bounds, "feed_id").filter(
        mine
        & (F.col("revision") > F.coalesce("_other", F.lit(-1)))
        & (F.col("revision") >= F.coalesce("_reset", F.lit(-1)))
        & F.col("line").isNotNull()
    )
    best = alive.groupBy("feed_id", "session_id", F.col("line.seq").alias("seq"), "_keep").agg(
        F.max_by("line", "revision").alias("line")
    )
    return best.filter(F.col("seq") >= F.col("_keep")).select("feed_id", "session_id", "line.*")


def dropped_chunks(chunks: DataFrame) -> DataFrame:
    """Missing chunk numbers per session, without ordering them.

    chunks: session_id, chunk_no (from 0, unique). ``expected`` chunks were
    sent; what did not arrive was dropped.
    """
    return chunks.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("received"), (F.max("chunk_no") + 1).alias("expected")
    ).withColumn("dropped", F.col("expected") - F.col("received"))


def epoch_offsets(epochs: DataFrame, rate: int, chunk_rows: int = 100_000) -> DataFrame:
    """Call-relative start of each epoch from the lengths before it.

    epochs: recording_id, epoch_no, samples.
    """
    total = running_total(
        epochs,
        ["recording_id"],
        ["epoch_no"],
        F.floor(F.col("epoch_no") / chunk_rows),
        F.col("samples"),
        "_sum",
    )
    return total.withColumn("base_samples", F.col("_sum") - F.col("samples")).withColumn(
        "offset_sec", F.col("base_samples") / F.lit(rate)
    ).drop("_sum")
