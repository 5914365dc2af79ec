"""Microphone edges to recording sessions.

signal: key, ts (any numeric clock), ord, on. All windows are in the units of
``ts``. ``ord`` breaks ties between edges at one instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import text
from parley.operators.ordered import first, islands, largest, last, running_peak, smallest, time_chunk


def on_intervals(signal: DataFrame, span: float) -> DataFrame:
    """One row per stretch of on-edges: on_at, off_at (NULL while open)."""
    runs = islands(
        signal,
        ["key"],
        ["ts", "ord"],
        time_chunk("ts", span),
        ["on"],
        lambda prev, cur: cur("on") & ~prev("on"),
        {
            "is_on": first("on"),
            "on_at": first("ts"),
            "off_at": smallest(F.when(~F.col("on"), F.col("ts"))),
        },
    )
    return runs.filter("is_on").drop("is_on")


def detect(
    signal: DataFrame, debounce: float, coalesce: float, minimum: float, span: float
) -> DataFrame:
    """Debounced, coalesced sessions.

    A session starts ``debounce`` after the first on-edge that holds that
    long. Gaps shorter than ``coalesce`` are absorbed. Its duration runs from
    the confirmed start to the last off-edge; shorter than ``minimum`` is
    flagged ``keep = false``. An open last interval leaves ``ended`` NULL.
    """
    spells = on_intervals(signal, span)
    holds = F.col("off_at").isNull() | (F.col("off_at") - F.col("on_at") >= debounce)
    groups = islands(
        spells,
        ["key"],
        ["on_at"],
        time_chunk("on_at", span),
        ["on_at", "off_at"],
        lambda prev, cur: cur("on_at") - prev("off_at") >= coalesce,
        {
            "armed_at": smallest(F.when(holds, F.col("on_at"))),
            "ended": last("off_at"),
        },
    )
    started = F.col("armed_at") + F.lit(debounce)
    length = F.col("ended") - started
    return groups.filter(F.col("armed_at").isNotNull()).select(
        "key",
        started.alias("started"),
        "ended",
        length.alias("duration"),
        F.when(F.col("ended").isNotNull(), length >= minimum).alias("keep"),
    )


def lifecycle(sessions: DataFrame, coalesce: float) -> DataFrame:
    """Started, finished and discarded events of detected sessions."""
    began = sessions.select("key", F.col("started").alias("ts"), F.lit("started").alias("event"), "started")
    closed = sessions.filter(F.col("ended").isNotNull()).select(
        "key",
        (F.col("ended") + F.lit(coalesce)).alias("ts"),
        F.when(F.col("keep"), "finished").otherwise("discarded").alias("event"),
        "started",
    )
    return began.unionByName(closed)


def best_owner(holders: DataFrame) -> DataFrame:
    """Most meaningful input holder per snapshot: known app, other app, first.

    holders: snapshot_id, ord, bundle_id, pid.
    """
    b = F.col("bundle_id")
    tier = (
        F.when(text.known_app(b).isNotNull(), 0).when(~text.is_system_helper(b), 1).otherwise(2)
    )
    pick = F.min_by(F.struct("bundle_id", "pid"), F.struct(tier, F.col("ord")))
    return holders.groupBy("snapshot_id").agg(pick.alias("_o")).select("snapshot_id", "_o.*")


def held_signal(holders: DataFrame, own_pid: int) -> DataFrame:
    """Whether any other call app holds input, per snapshot, as a signal row."""
    counts = (F.col("pid") != own_pid) & text.is_call_owner(F.col("bundle_id"))
    return holders.groupBy("key", "snapshot_id", "ts").agg(
        F.bool_or(F.coalesce(counts, F.lit(False))).alias("on")
    )


def smooth_turns(turns: DataFrame, min_on: float, min_off: float, span: float) -> DataFrame:
    """Bridge short gaps inside one speaker, then drop turns that stay short.

    A gap counts from the furthest end so far: a short turn inside a longer
    one neither opens a gap nor shortens it.
    """
    keys, order, chunk = ["recording_id", "label"], ["start", "seq"], time_chunk("start", span)
    merged = islands(
        running_peak(turns, keys, order, chunk, F.col("end"), "_reach"),
        keys,
        order,
        chunk,
        ["start", "_reach"],
        lambda prev, cur: cur("start") - cur("_reach") >= min_off,
        {"start": first("start"), "end": largest(F.col("end")), "seq": first("seq")},
    )
    return merged.filter(F.col("end") - F.col("start") >= min_on)

