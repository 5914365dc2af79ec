"""Shards of near-equal bytes by histogram sort.

The splitters of a sort are found by counting instead of sorting: probes cut
the key range into equal steps, one grouped sum per round gives the exact bytes
below every probe, and the next round probes only the steps that hold a
splitter, until the bytes below every splitter are near enough to their target.
Rows then move once, to their final place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import search_tree
from parley.session import settle

#: Steps into which a round cuts the key range around each splitter.
STEPS = 256
LEAST, MOST = -(2**63), 2**63 - 1


def text_bytes(text: str = "text", overhead: int = 16) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


@dataclass
class _Search:
    """One splitter: rows before it hold at least ``target`` bytes and no row fewer does.

    ``base`` bytes lie before ``low``; the splitter lies in (low, low + width].
    """

    target: int
    low: int
    width: int
    base: int
    found: int | None = None


def _narrow(spark: SparkSession, sizes: DataFrame, key: str, searches: list[_Search], slack: int) -> None:
    """Probe ``key`` until every search has its splitter, or one within ``slack`` bytes."""
    while open_ := [s for s in searches if s.found is None]:
        ranges = sorted({(s.low, s.width) for s in open_})
        lows = [low for low, _ in ranges]
        steps = [max(1, -(-width // STEPS)) for _, width in ranges]
        number = search_tree(-1, lows, lambda low: F.col(key) < F.lit(low))
        place = lambda values: F.element_at(F.array(*[F.lit(str(v)).cast("decimal(20,0)") for v in values]), F.col("r") + 1)
        counted = (
            sizes.select(key, "size", number.alias("r"))
            .filter("r >= 0")
            .select("r", "size", F.expr(f"cast({key} as decimal(20,0))").alias("k"), place(lows).alias("low"), place(steps).alias("step"), place([w for _, w in ranges]).alias("width"))
            .filter("k - low < width")
            .groupBy("r", F.expr("(k - low) div step").alias("step_no"))
            .agg(F.sum("size").alias("bytes"))
        )
        # At most STEPS rows for each splitter, whatever the input.
        bytes_of: dict[int, list[tuple[int, int]]] = {}
        for row in counted.collect():
            bytes_of.setdefault(row["r"], []).append((row["step_no"], row["bytes"]))
        for s in open_:
            r = ranges.index((s.low, s.width))
            before = s.base
            for step_no, held in sorted(bytes_of.get(r, [])):
                end = s.low + (step_no + 1) * steps[r]
                if before + held >= s.target:
                    if steps[r] == 1 or before + held - s.target <= slack:
                        s.found, s.base = end, before
                    elif s.target - before <= slack:
                        s.found, s.base = s.low + step_no * steps[r], before
                    else:
                        s.low, s.width, s.base = s.low + step_no * steps[r], steps[r], before
                    break
                before += held
            else:
                s.found = s.low + s.width


def splitters(spark: SparkSession, sizes: DataFrame, parts: int, tolerance: float = 0.0) -> list[tuple[int, int]]:
    """Keys (k1, k2) that begin part 1, 2 ... of ``parts`` parts of equal bytes.

    ``sizes`` has long columns ``k1``, ``k2`` and ``size`` and is read once for
    every round of probes. A splitter is the first key with at least its target
    of bytes below it; with a ``tolerance`` (a share of one part's bytes) an
    earlier round's probe within it serves. Rows that agree in both keys are
    never parted.
    """
    whole = sizes.agg(F.sum("size"), F.min("k1"), F.max("k1"), F.min("k2"), F.max("k2")).first()
    total = whole[0]
    if not total:
        return []
    slack = int(tolerance * total / parts)
    searches = [_Search(-(-total * p // parts), whole[1], whole[2] - whole[1] + 1, 0) for p in range(1, parts)]
    _narrow(spark, sizes, "k1", searches, slack)
    # A single k1 that overshoots its target is parted by k2.
    split: list[tuple[int, int]] = []
    inner: dict[int, list[tuple[int, _Search]]] = {}
    ends = sizes.filter(F.col("k1").isin([s.found - 1 for s in searches])).groupBy("k1")
    several = {
        r["k1"]: r["bytes"]
        for r in ends.agg(F.sum("size").alias("bytes"), F.min("k2").alias("a"), F.max("k2").alias("b")).filter("a <> b").collect()
    }
    for n, s in enumerate(searches):
        split.append((s.found, LEAST))
        if s.base < s.target < s.base + several.get(s.found - 1, 0) - slack:
            inner.setdefault(s.found - 1, []).append((n, _Search(s.target, whole[3], whole[4] - whole[3] + 1, s.base)))
    for k1, group in inner.items():
        _narrow(spark, sizes.filter(F.col("k1") == k1), "k2", [s for _, s in group], slack)
        for n, s in group:
            split[n] = (k1, s.found) if s.found <= MOST else (k1 + 1, LEAST)
    return split


def shard(
    docs: DataFrame,
    shards: int = 40,
    key: str = "doc_id",
    text: str = "text",
    overhead: int = 16,
    tolerance: float = 0.0,
    cells: int = 4,
) -> DataFrame:
    """Sort rows by ``key`` into ``shards`` shards of near-equal bytes.

    Adds ``size`` (UTF-8 bytes of the text plus ``overhead``; a NULL text has
    none), ``shard`` and ``slot``, the row's gapless place in its shard in key
    order. Rows of one key are ordered by a hash of their text; a NULL key
    sorts first. Columns of those names in the input are replaced, all others
    are kept. An empty table gives an empty result.

    Every shard is ordered in ``cells`` tasks of its own, so a shard need not
    fit into one. All but the key and the size of a row stays behind until the
    one exchange at the end. Bytes of two shards differ by less than two rows,
    or two key groups of equal text, plus the tolerance.
    """
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c not in ("size", "shard", "slot")])
    keyed = docs.withColumns(
        {
            "size": text_bytes(text, overhead),
            "k1": F.coalesce(F.col(key).cast("long"), F.lit(LEAST)),
            "k2": F.xxhash64(text),
        }
    )
    sizes = settle(spark, keyed.select("k1", "k2", "size"), "shard-sizes")
    bounds = splitters(spark, sizes, shards * cells, tolerance)
    before = lambda b: (F.col("k1") < F.lit(b[0])) | ((F.col("k1") == F.lit(b[0])) & (F.col("k2") < F.lit(b[1])))
    bounds = [(min(a, MOST), b) for a, b in bounds]
    cell = search_tree(0, bounds, before)
    counts = dict(sizes.groupBy(cell.alias("cell")).count().collect())  # one row a cell
    starts = [sum(counts.get(c, 0) for c in range(at - at % cells, at)) for at in range(shards * cells)]
    ordered = W.partitionBy("cell").orderBy("k1", "k2")
    return (
        keyed.withColumn("cell", cell)
        .withColumn("slot", F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("cell") + 1) + F.row_number().over(ordered) - 1)
        .withColumn("shard", F.floor(F.col("cell") / cells).cast("int"))
        .drop("k1", "k2", "cell")
    )


