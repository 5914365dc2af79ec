"""Ordered work inside a key, without putting a whole key into one task.

A window partitioned by a recording alone sends all of that recording to one
task. Here every key is cut into *chunks* along its order; the heavy work runs
per (key, chunk) and only one or two summary rows per chunk are ever ordered
per key. A key that holds a third of the table is then many tasks' work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import dealt

CHUNK_ROWS = 100_000


def row_chunk(order: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk by a unique integer ordinal: at most ``rows`` rows per chunk."""
    return F.floor(F.col(order) / F.lit(rows))


def time_chunk(order: str, span: float) -> Column:
    """Chunk by a numeric time axis (any unit), ``span`` units per chunk."""
    return F.floor(F.col(order) / F.lit(span))


@dataclass(frozen=True)
class Fold:
    """An aggregate with a per-piece form and a form that joins pieces."""

    partial: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Pick:
    """A value of a run's first (or last) row.

    All picks of one end travel in one struct, so they cost one aggregate.
    """

    expr: Column
    at_end: bool


def first(expr: Column | str) -> Pick:
    return Pick(F.col(expr) if isinstance(expr, str) else expr, False)


def last(expr: Column | str) -> Pick:
    return Pick(F.col(expr) if isinstance(expr, str) else expr, True)


def total(expr: Column) -> Fold:
    return Fold(lambda o: F.sum(expr), lambda p, o: F.sum(p))


def rows() -> Fold:
    return Fold(lambda o: F.count(F.lit(1)), lambda p, o: F.sum(p))


def smallest(expr: Column) -> Fold:
    return Fold(lambda o: F.min(expr), lambda p, o: F.min(p))


def largest(expr: Column) -> Fold:
    return Fold(lambda o: F.max(expr), lambda p, o: F.max(p))


def in_order(value: Column, order: Column) -> Column:
    """Values of a group as an array sorted by ``order``."""
    return F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))["v"]


def joined(expr: Column | str, sep: str) -> Fold:
    c = F.col(expr) if isinstance(expr, str) else expr
    return Fold(
        lambda o: F.array_join(in_order(c, o), sep),
        lambda p, o: F.array_join(in_order(p, o), sep),
    )


Rule = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    carry: Sequence[str],
    breaks: Rule,
    folds: dict[str, Fold | Pick],
) -> DataFrame:
    """Fold runs of consecutive rows; a run ends where ``breaks`` holds.

    ``breaks(prev, cur)`` gets two accessors over the ``carry`` columns of the
    previous and the current row. Rows are folded into pieces per (keys,
    chunk). Only pieces that touch a chunk edge, at most two per chunk, are
    then ordered per key; inner pieces stay spread by chunk. Two shuffles, the
    second one of pieces.
    """
    keys = list(keys)
    part = [*keys, "_chunk"]
    here = Window.partitionBy(*part).orderBy(*order)
    heads = {n: f for n, f in folds.items() if isinstance(f, Pick) and not f.at_end}
    tails = {n: f for n, f in folds.items() if isinstance(f, Pick) and f.at_end}
    sums = {n: f for n, f in folds.items() if isinstance(f, Fold)}
    carried = [F.col(c) for c in carry]
    whole_row = lambda picks: F.struct(*carried, *[f.expr.alias(f"_{n}") for n, f in picks.items()])
    marked = dealt(df.withColumn("_chunk", chunk), *part).withColumn("_prev", F.lag(F.struct(*carried)).over(here))
    starts = F.col("_prev").isNull() | F.coalesce(
        breaks(lambda c: F.col("_prev")[c], lambda c: F.col(c)), F.lit(False)
    )
    marked = marked.withColumn("_new", F.when(starts, 1).otherwise(0)).withColumn(
        "_piece", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0))
    )
    at = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    pieces = marked.groupBy(*part, "_piece").agg(
        F.min_by(whole_row(heads), at).alias("_head"),
        F.max_by(whole_row(tails), at).alias("_tail"),
        *[f.partial(at).alias(n) for n, f in sums.items()],
    )
    pieces = pieces.withColumn("_pieces", F.max("_piece").over(Window.partitionBy(*part)))
    edge = (F.col("_piece") == 1) | (F.col("_piece") == F.col("_pieces"))
    # Edge pieces of a key share one lane; inner pieces keep their chunk's.
    lane = [*keys, "_lane"]
    laned = dealt(pieces.withColumn("_lane", F.when(~edge, F.col("_chunk"))), *lane)
    along = Window.partitionBy(*lane).orderBy("_chunk", "_piece")
    before = laned.withColumn(
        "_before", F.lag(F.struct(F.col("_chunk").alias("chunk"), F.col("_tail").alias("tail"))).over(along)
    )
    fresh = (
        F.col("_before").isNull()
        | (F.col("_before.chunk") == F.col("_chunk"))
        | F.coalesce(
            breaks(lambda c: F.col("_before")["tail"][c], lambda c: F.col("_head")[c]), F.lit(False)
        )
    )
    runs = before.withColumn("_fresh", F.when(fresh, 1).otherwise(0)).withColumn(
        "_run", F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    place = F.struct(F.col("_chunk"), F.col("_piece"))
    whole = runs.groupBy(*lane, "_run").agg(
        F.min_by("_head", place).alias("_head"),
        F.max_by("_tail", place).alias("_tail"),
        *[f.merge(F.col(n), place).alias(n) for n, f in sums.items()],
    )
    value = lambda n: (
        F.col("_head")[f"_{n}"] if n in heads else F.col("_tail")[f"_{n}"] if n in tails else F.col(n)
    )
    return whole.select(*keys, *[value(n).alias(n) for n in folds])


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` inside ``keys``.

    ``chunk`` must grow with ``order``. Chunk totals are pre-aggregated before
    their shuffle, so the per-key window sees one row per chunk.
    """
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk).withColumn("_v", value)
    along = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.sum("_v").alias("_sum"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
        .drop("_sum")
    )
    here = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.join(base, [*keys, "_chunk"])
        .withColumn(name, F.sum("_v").over(here) + F.col("_base"))
        .drop("_chunk", "_v", "_base")
    )


def running_peak(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], chunk: Column, value: Column, name: str
) -> DataFrame:
    """Greatest ``value`` of the rows before each row along ``order``; NULL on the first.

    ``chunk`` must grow with ``order``; the per-key window sees one row per chunk.
    """
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk).withColumn("_v", value)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.max("_v").alias("_top"))
        .withColumn("_base", F.max("_top").over(before(Window.partitionBy(*keys).orderBy("_chunk"))))
        .drop("_top")
    )
    here = before(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    return (
        cut.join(base, [*keys, "_chunk"])
        .withColumn(name, F.greatest(F.max("_v").over(here), F.col("_base")))
        .drop("_chunk", "_v", "_base")
    )


#: Folds of ``scan_before``: over rows, and of two results of which one may be NULL.
SCANS = {
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0)))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def scan_before(df: DataFrame, order: str, value: str, how: str, name: str, span: int = 1000, levels: int = 2) -> DataFrame:
    """Fold of ``value`` over all rows with a smaller ``order``; NULL on the first.

    ``order`` is a unique whole number of any sign, ``how`` one of SCANS. A tree of blocks of ``span`` numbers: each block is
    folded, what stands before a block is the same scan over blocks, and only
    the blocks of the last level, ``span`` ** ``levels`` numbers each, are in
    one window.
    """
    fold, merged = SCANS[how]
    before = lambda w: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if levels == 0:
        # A row for each block of the last level: the range of the numbers over span ** levels.
        return df.withColumn(name, fold(F.col(value)).over(before(Window.partitionBy(F.lit(0)))))
    cut = df.withColumn("_block", F.floor(F.col(order) / span))
    blocks = cut.groupBy("_block").agg(fold(F.col(value)).alias("_v")).select(F.col("_block").alias(order), F.col("_v").alias(value))
    carried = scan_before(blocks, order, value, how, "_carry", span, levels - 1).select(F.col(order).alias("_block"), "_carry")
    here = fold(F.col(value)).over(before(Window.partitionBy("_block")))
    both = cut.withColumn("_here", here).join(carried, "_block")
    return both.select(*df.columns, merged(F.col("_here"), F.col("_carry")).alias(name))


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``by``. Combines map-side."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")
    )
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
