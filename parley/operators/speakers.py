"""Grouping voice embeddings into speakers.

vectors: recording_id, vec_id, embedding array<float>, and optionally start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import maths
from parley.operators.ordered import in_order, row_chunk, running_total
from parley.session import settle

#: Vectors of a recording that meet those of another block in one task.
BLOCK = 1024


def unit(embedding: Column) -> Column:
    norm = F.sqrt(maths.energy(embedding))
    return F.transform(embedding, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def links(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links that join all vectors of a recording whose cosine reaches the threshold.

    Exact: a recording is cut into blocks of about ``block`` vectors and every
    two blocks meet in one task, as a product of two matrices. A task answers
    with a forest over its vectors (each to the smallest it is joined with),
    so the answer has at most one row per vector and task, however alike the
    vectors are. Work grows with the square of a recording's length, spread
    over all its pairs of blocks; different recordings never meet.
    """
    v = vectors.select("recording_id", "vec_id", unit(F.col("embedding")).alias("u")).filter("u is not null")
    blocks = v.groupBy("recording_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    own = F.pmod(F.xxhash64("vec_id"), F.col("_blocks"))
    placed = v.join(blocks, "recording_id").withColumn("_own", own)
    sent = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).select(
        "recording_id", "vec_id", "u", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")
    )

    def forest(part: pd.DataFrame) -> pd.DataFrame:
        ids, u = part["vec_id"].to_numpy(), np.stack(part["u"].to_numpy())
        rows, cols = (np.flatnonzero(part["_own"] == part[side].iloc[0]) for side in ("_i", "_j"))
        alike = u[rows] @ u[cols].T >= threshold
        low, far = ids.copy(), np.iinfo(np.int64).max
        if len(rows) and len(cols):
            while True:
                was = low.copy()
                low[rows] = np.minimum(low[rows], np.where(alike, low[cols], far).min(axis=1))
                low[cols] = np.minimum(low[cols], np.where(alike, low[rows][:, None], far).min(axis=0))
                if (low == was).all():
                    break
        told = low != ids
        return pd.DataFrame({"recording_id": part["recording_id"].iloc[0], "a": low[told], "b": ids[told]})

    kind = v.schema["recording_id"].dataType.simpleString()
    return sent.groupBy("recording_id", "_i", "_j").applyInPandas(forest, f"recording_id {kind}, a long, b long").distinct()


def components(spark: SparkSession, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest vec_id of each connected component.

    Recordings whose links already lead straight to the smallest, as those of
    one block do, take no rounds. Every round takes the smallest label among neighbours, then jumps to the
    label's own label, so rounds grow with the logarithm of a component's
    diameter. State is written out between rounds; a lost executor replays one
    round, not the chain.
    """
    pairs = settle(spark, links.select("recording_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    sides = pairs.select("recording_id", F.col("a").alias("v"), F.lit(0).alias("n")).unionByName(pairs.select("recording_id", F.col("b").alias("v"), F.lit(1).alias("n")))
    seen = sides.groupBy("recording_id", "v").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    # Where no end of a link is the start of another, or the end of two, the links are the answer.
    # Recordings with a vec_id more than once take the rounds, too.
    twice = nodes.groupBy("recording_id", "vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    open_ = seen.filter("n > 1 or (n = 1 and least = 0)").select("recording_id").unionByName(twice.select("recording_id"))
    knotted = settle(spark, open_.distinct(), "knotted")
    plain = nodes.join(knotted, "recording_id", "left_anti").select("recording_id", "vec_id").join(
        pairs.join(knotted, "recording_id", "left_anti").select("recording_id", F.col("b").alias("vec_id"), F.col("a").alias("_root")), ["recording_id", "vec_id"], "left"
    )
    plain = plain.select("recording_id", "vec_id", F.coalesce("_root", "vec_id").alias("comp"))
    if knotted.isEmpty():
        return plain
    links, nodes = (df.join(knotted, "recording_id", "left_semi") for df in (pairs, nodes))
    both = links.unionByName(links.select("recording_id", F.col("b").alias("a"), F.col("a").alias("b")))
    both = settle(spark, both, "links")
    state = settle(spark, nodes.select("recording_id", "vec_id", F.col("vec_id").alias("comp")), "comp")
    while True:
        near = (
            both.join(
                state.select("recording_id", F.col("vec_id").alias("b"), F.col("comp").alias("_c")),
                ["recording_id", "b"],
            )
            .groupBy("recording_id", F.col("a").alias("vec_id"))
            .agg(F.min("_c").alias("_m"))
        )
        low = state.join(near, ["recording_id", "vec_id"], "left").select(
            "recording_id", "vec_id", F.col("comp").alias("_old"), F.least("comp", "_m").alias("comp")
        )
        jump = low.select("recording_id", F.col("vec_id").alias("comp"), F.col("comp").alias("_j"))
        nxt = low.join(jump, ["recording_id", "comp"], "left").select(
            "recording_id", "vec_id", "_old", F.least("comp", "_j").alias("comp")
        )
        nxt = settle(spark, nxt, "comp")
        state = nxt.drop("_old")
        if nxt.filter(F.col("comp") != F.col("_old")).limit(1).count() == 0:
            return plain.unionByName(state)


def number_speakers(assigned: DataFrame, order: str = "vec_id") -> DataFrame:
    """Labels ``Them N`` per recording in order of first appearance."""
    seen = assigned.groupBy("recording_id", "comp").agg(F.min(order).alias("_first"))
    numbered = running_total(seen, ["recording_id"], ["_first"], row_chunk("_first"), F.lit(1), "_n")
    named = numbered.withColumn("speaker", F.concat(F.lit("Them "), F.col("_n").cast("string")))
    return assigned.join(named.select("recording_id", "comp", "speaker"), ["recording_id", "comp"])


def by_threshold(spark: SparkSession, vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Unknown speaker count: linked vectors share a speaker."""
    comps = components(spark, vectors, links(vectors, threshold, block))
    return number_speakers(comps)


def _seeds(vectors: DataFrame, k: int, pool: int) -> DataFrame:
    """``k`` first centres of each recording, far from each other, out of ``pool`` vectors chosen by hash."""
    by_hash = Window.partitionBy("recording_id").orderBy(F.xxhash64("vec_id"), "vec_id")
    some = vectors.withColumn("_rn", F.row_number().over(by_hash)).filter(F.col("_rn") <= pool).drop("_rn")

    def spread(part: pd.DataFrame) -> pd.DataFrame:
        u = np.stack(part.sort_values("vec_id")["u"].to_numpy())
        chosen, near = [0], u @ u[0]
        while len(chosen) < min(k, len(u)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, u @ u[chosen[-1]])
        return pd.DataFrame({"recording_id": part["recording_id"].iloc[:1].tolist(), "centres": [u[chosen].tolist()]})

    kind = vectors.schema["recording_id"].dataType.simpleString()
    return some.groupBy("recording_id").applyInPandas(spread, f"recording_id {kind}, centres array<array<double>>")


def _nearest() -> Column:
    """Place of the centre with the greatest cosine, the first of equal ones."""
    scored = F.transform("centres", lambda c, i: F.struct(maths.dot(F.col("u"), c).alias("s"), (-i).alias("i")))
    return (-F.array_max(scored)["i"]).cast("long")


def pinned(spark: SparkSession, vectors: DataFrame, k: int, rounds: int | None = None) -> DataFrame:
    """Known speaker count: k-means by cosine inside each recording.

    Centres start as vectors far from each other, out of at most ``32 * k`` of
    a recording. Every round assigns all vectors and sums them per (recording,
    centre) before anything moves, and writes the centres out, until no centre
    moves; only recordings whose centres have moved take part in the next one. With ``rounds``, that many without an end are an error. A recording with fewer vectors than
    ``k`` has as many speakers as vectors.
    """
    v = vectors.select("recording_id", "vec_id", unit(F.col("embedding")).alias("u")).filter("u is not null")
    v = settle(spark, v, "vectors")
    centres = settle(spark, _seeds(v, k, 32 * k), "centres")
    done, ended = 0, None
    while True:
        if rounds is not None and done >= rounds:
            raise RuntimeError(f"speakers have not settled after {rounds} rounds")
        done += 1
        member = v.join(centres, "recording_id").select("recording_id", _nearest().alias("comp"), array_to_vector("u").alias("x"))
        mean = member.groupBy("recording_id", "comp").agg(unit(vector_to_array(Summarizer.mean(F.col("x")))).alias("c"))
        moved = mean.groupBy("recording_id").agg(in_order(F.col("c"), F.col("comp")).alias("centres"))
        steps = F.zip_with(F.flatten("centres"), F.flatten("_was"), lambda a, b: F.abs(a - b))
        shift = F.coalesce(F.array_max(steps), F.lit(0.0))
        both = moved.join(centres.withColumnRenamed("centres", "_was"), "recording_id")
        moves = (F.size("centres") != F.size("_was")) | (shift > 1e-9)
        both = settle(spark, both.select("recording_id", "centres", F.coalesce(moves, F.lit(False)).alias("_moves")), "centres")
        still, centres = (both.filter(which).drop("_moves") for which in ("not _moves", "_moves"))
        ended = still if ended is None else ended.unionByName(still)
        if centres.isEmpty():
            break
    return number_speakers(v.join(ended, "recording_id").select("recording_id", "vec_id", _nearest().alias("comp")))
