"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, more: str) -> T.StructType:
    """The schema of ``df`` with the fields of a DDL text behind it."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def search_tree(position: int, bounds: list, below) -> Column:
    """Number of ``bounds`` (sorted) at or before a row, by nested comparisons.

    ``below(bound)`` is the condition that a row lies before ``bound``.
    ``position`` is the number that stands for no bound at all.
    """
    if not bounds:
        return F.lit(position)
    half = len(bounds) // 2
    return F.when(below(bounds[half]), search_tree(position, bounds[:half], below)).otherwise(
        search_tree(position + half + 1, bounds[half + 1 :], below)
    )


def components(spark: SparkSession, links: DataFrame, name: str) -> DataFrame:
    """Smallest id of each linked node: distributed union-find.

    ``links`` has columns ``a`` and ``b``, both ids of one orderable type.
    Large-star and small-star steps alternate until the forest is all stars;
    each round is one write to the shared folder, so lineage stays short and
    nothing but a count and a checksum reaches the driver. A hub of many links
    is a skewed join key, which adaptive execution splits.

    Returns ``id`` and ``root`` for every node that has a link; a link from a
    node to itself or to NULL says nothing and is left out.
    """
    edges = (
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    edges = settle(spark, edges, name)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u")
        edges = settle(
            spark,
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .filter("u <> v")
            .distinct(),
            name,
        )
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


#: Bits of the filter of ``thinned``: two MB, whatever the input.
FILTER_BITS = 1 << 24


def thinned(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among the one column of ``ids``: all that are, and few others.

    A Bloom filter of one hash and a fixed number of bits, sent to all tasks as
    a table of at most FILTER_BITS / 64 rows. With very many ids it lets
    everything through, which makes a later exchange longer and nothing else.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    name = ids.columns[0]
    words = ids.select(bit(name).alias("b")).groupBy(F.expr("b div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("_bits"))
    marked = df.withColumn("_bit", bit(column))
    found = marked.join(F.broadcast(words), F.expr("_bit div 64") == F.col("_word"))
    return found.filter("shiftrightunsigned(_bits, cast(_bit % 64 as int)) % 2 <> 0").select(*df.columns)


#: Members of a bucket that are all compared: at most half as many pairs a row.
SMALL = 16


def bucket_components(
    spark: SparkSession,
    rows: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    name: str,
    narrow: Callable[[DataFrame], DataFrame] | None = None,
    small: int = SMALL,
    cross: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components of the verified links between ids that share a bucket: (id, root).

    ``rows`` has ``bucket`` and ``id``; ``verify`` takes pairs (a, b), a < b,
    and returns those that are links. Ids are first paired with the smallest of
    each bucket, so a bucket of many alike ids costs as many pairs as it has
    members. After a union-find, buckets whose members are still in different
    components are looked at again: ``narrow`` takes their (id, root) and
    returns pairs (a, b), a < b, of different roots, among them every link.
    Buckets of at most ``small`` members are paired as they are.
    So the components hold all links between ids that share a bucket. Without
    ``narrow``, members of different roots in a bucket are the pairs: right
    where ids that share a bucket are nearly always links. ``cross`` does all of
    the second look: it takes the members of these buckets (bucket, id, root
    and their number ``n``) and the pairs that were looked at, and returns links.
    """
    bucket = W.partitionBy("bucket")
    met = rows.withColumns({"hub": F.min("id").over(bucket), "most": F.max("id").over(bucket)}).filter("hub < most")
    met = settle(spark, met.select("bucket", "id", "hub"), name)
    first = met.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    first = settle(spark, first, name)
    links = settle(spark, verify(first).select("a", "b"), name)
    roots = components(spark, links, name)
    members = met.select("bucket", "id").distinct().join(roots, "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    mixed = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"))
    mixed = mixed.filter("x <> y and n > 2").select("bucket", "n")
    apart = settle(spark, members.join(mixed, "bucket"), name)
    if cross is not None:
        return components(spark, links.unionByName(cross(apart, first).select("a", "b")), name)
    few = apart if narrow is None else apart.filter(F.col("n") <= small)
    x, y = few.alias("x"), few.alias("y")
    crossing = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")))
    pairs = crossing.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    if narrow is not None:
        pairs = pairs.unionByName(narrow(apart.filter(F.col("n") > small).select("id", "root").distinct())).distinct()
    second = pairs.join(first, ["a", "b"], "left_anti")
    more = verify(settle(spark, second, name)).select("a", "b")
    return components(spark, links.unionByName(more), name)
