"""Mixing sources to target weights by proportionate-fair scheduling.

Each source is cut into blocks. Block j of a source with weight w (a share of
one) may not come before slot floor(j / w) and must come before slot
ceil((j + 1) / w); earliest deadline first among the released blocks meets
every deadline, so after any number of slots each source has had its share of
them, up to less than one block. Weights are taken as they are, as fractions:
the schedule is worked out for every block, and rows find the slot of theirs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.sharding import text_bytes

#: Rows whose sizes are added up in one task.
SUMMED_ROWS = 100_000
#: Blocks up to which the schedule is sent to all tasks; a longer one is joined by exchange.
SENT_BLOCKS = 1_000_000


def whole_weights(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Weights as counts of ``period``, at least 1 each, by largest remainder."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    counts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (counts[s] - exact[s], s))
    at = 0
    while sum(counts.values()) != period:
        if sum(counts.values()) < period:
            counts[order[at % len(order)]] += 1
        else:
            large = max(counts, key=lambda s: (counts[s] - exact[s] if counts[s] > 1 else -period, s))
            counts[large] -= 1
        at += 1
    return counts


def scheduled(weights: Mapping[str, int], left: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source until one has no block left: earliest deadline first among released blocks."""
    total = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in sorted(weights)]  # (release, source) of each source's next block
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(slot)
        if len(slots[s]) == left[s]:
            return slots
        heapq.heappush(waiting, (len(slots[s]) * total // weights[s], s))
        slot += 1


def period_slots(counts: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period of its counts."""
    period = sum(counts.values())
    slots = scheduled(counts, {s: n + 1 for s, n in counts.items()})
    return {s: [x for x in found if x < period] for s, found in slots.items()}


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Weights as whole numbers in the very proportions given."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[w.denominator for w in exact.values()])
    return {s: int(w * unit) for s, w in exact.items()}


def schedule(weights: Mapping[str, float], blocks: Mapping[str, int], period: int | None = None) -> Iterator[tuple]:
    """(source, block, phase, release, deadline, slot) of all blocks.

    When a source has no block left, a new phase begins and the others go on by
    their weights. With a ``period`` weights are rounded to counts of it.
    """
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    start = phase = 0
    while left:
        now = {s: weights[s] for s in left}
        counts = exact_weights(now) if period is None else whole_weights(now, max(period, 8 * len(left)))
        total = sum(counts.values())
        slots = scheduled(counts, left)
        for s, found in slots.items():
            for j, slot in enumerate(found):
                yield s, done[s] + j, phase, start + j * total // counts[s], start - (-(j + 1) * total // counts[s]), start + slot
            done[s] += len(found)
            left[s] -= len(found)
        start += sum(map(len, slots.values()))
        left = {s: n for s, n in left.items() if n}
        phase += 1


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    block_bytes: int = 64_000,
    period: int | None = None,
    temper: float = 0.5,
) -> DataFrame:
    """Give every row its place in a mix of the sources.

    A source's rows are put in a fixed random order (a hash of source, key and
    text) and cut into blocks of ``block_bytes`` of text plus 16 bytes a row; a
    row belongs to the block in which it begins, so a row longer than a block
    leaves numbers without rows, and slots without rows. Adds ``size``,
    ``block``, ``phase`` (sources that had ended before), ``release`` and
    ``deadline`` (slots), ``slot`` and ``place`` (order within the block).
    Sorting by ``slot`` and ``place`` gives the mix. No row is dropped or
    repeated: when a source ends, the others go on by their weights.

    ``weights`` are shares of any sum; a source without one, or with 0,
    gets the least given. Without weights they are the sources' bytes to the power
    ``temper``. NULL is a source of its own, a NULL text has no bytes, repeated
    rows follow one another, an empty table gives an empty result. Columns of
    the added names are replaced, others kept.

    A source's bytes are added up in parts of a bounded number of rows, so one
    that holds a third of them is many tasks. One row a source, its number of
    blocks, reaches the driver, and one row a block goes back. Without
    ``period`` the weights are exact, however long the input.
    """
    spark = docs.sparkSession
    made = ["size", "block", "phase", "release", "deadline", "slot", "place"]
    keep = [c for c in docs.columns if c not in made]
    rows = docs.select(
        *keep,
        text_bytes(text).alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_source"),
        F.xxhash64(source, key, text).alias("_order"),
    )
    parts = max(1, -(-docs.count() // SUMMED_ROWS))
    rows = rows.withColumn("_part", F.floor((F.shiftrightunsigned("_order", 1) / F.lit(2.0**63)) * parts).cast("int"))
    sums = rows.groupBy("_source", "_part").agg(F.sum("size").alias("_bytes"))
    earlier = W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_source", "_part", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_start"))
    totals = {r["_source"]: r["bytes"] for r in sums.groupBy("_source").agg(F.sum("_bytes").alias("bytes")).collect()}
    if not totals:
        return rows.select(*keep, "size", *[F.lit(None).cast("long").alias(c) for c in made[1:]])
    blocks = {s: -(-b // block_bytes) for s, b in totals.items()}
    if weights is None:
        wanted = {s: Fraction(float(b) ** temper) for s, b in totals.items()}
    else:
        least = min((w for w in weights.values() if w > 0), default=1)
        wanted = {s: w if (w := weights.get(s[1:], least)) > 0 else least for s in totals}
    plan = list(schedule(wanted, blocks, period))
    planned = spark.createDataFrame(plan, "_source string, block long, phase long, release long, deadline long, slot long")
    planned = F.broadcast(planned) if len(plan) <= SENT_BLOCKS else planned
    row = W.partitionBy("_source", "_part").orderBy("_order", key, F.xxhash64(*keep))
    before = F.coalesce(F.sum("size").over(row.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Keys and partitions of the sum are those of the join, so rows move once for both.
    placed = rows.withColumn("_before", before).join(starts, ["_source", "_part"]).withColumn("_at", F.col("_start") + F.col("_before"))
    blocked = placed.withColumn("block", F.floor(F.col("_at") / block_bytes))
    found = blocked.join(planned, ["_source", "block"])
    place = F.col("_at") - F.col("block") * block_bytes
    return found.select(*keep, "size", "block", "phase", "release", "deadline", "slot", place.alias("place"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix as rows in order: written out, its files hold the schedule one after another."""
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
