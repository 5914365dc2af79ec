"""Similarity join of word-shingle sets by parity sketches.

A document's shingles are hashed; the hash chooses a piece of a sketch and a
bit in it, and the bit is flipped. A bit of a sketch is then the parity of the
shingles that met there, and two sketches differ in no more bits than their
sets differ in shingles. Sets similar enough differ in at most d shingles, with
d known from their sizes, so a sketch of d + 1 pieces has at least one piece in
common with that of any partner: sets are joined on whole pieces, size band by
size band, and what meets is verified on the shingles themselves.

A piece has 2^64 bits, one for each hash, and is held as the XOR of the hashes
whose bits are set: equal bits, equal XOR. Pieces without a set bit would join
sets that have nothing in common. A sketch therefore has a few pieces to spare,
and only a set with more empty pieces than that joins on them: any other pair
of linked sets also agrees in a piece that is not empty.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import bucket_components, shuffle_width, thinned
from parley.session import settle

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Distinct words remembered at once in a task.
REMEMBERED_WORDS = 500_000


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words; two sets link when 100 * intersection >= percent * union."""

    words: int = 3
    percent: int = 90


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes."""

    def __init__(self, words: int) -> None:
        self.words, self.seen = words, {}

    def _hash(self, word: bytes) -> int:
        h = self.seen.get(word)
        if h is None:
            if len(self.seen) >= REMEMBERED_WORDS:
                self.seen.clear()
            h = self.seen[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else ()
        if not words:
            return np.empty(0, np.uint64)
        h = np.array([self._hash(w) for w in words], np.uint64)
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(ODD[k % len(ODD)])
            out ^= out >> np.uint64(29)
        return np.unique(out)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


@lru_cache(maxsize=16)
def _bands(percent: int, most: int) -> np.ndarray:
    """First sizes of the bands up to ``most``: a partner is in the same band or a neighbouring one."""
    firsts = [1]
    while firsts[-1] <= most:
        firsts.append(firsts[-1] * 100 // percent + 1)
    return np.array(firsts)


def band(size: int, percent: int) -> int:
    return int(np.searchsorted(_bands(percent, 1 << max(10, size.bit_length())), size, side="right")) - 1


def pieces_of_band(number: int, percent: int) -> tuple[int, int]:
    """Pieces of a sketch in a band, and how many of them are to spare.

    Without those it is one more than the shingles in which two linked sets can
    differ if neither is larger than the band.
    """
    most = 1
    for _ in range(number + 1):
        most = most * 100 // percent + 1
    differ = 2 * (most - 1) * (100 - percent) // (100 + percent)
    # The fewest shingles a piece can expect, for the smallest set that comes into the
    # band from the one below, give the share of pieces that may stay empty.
    t = percent / 100
    empty = differ * math.exp(-0.9 * t * t * (1 + t) / (2 * (1 - t))) if percent < 100 else 0.0
    spare = (differ > 0) * (1 + int(1.3 * empty + 3 * math.sqrt(empty)))
    return differ + 1 + spare, spare


def sketch(shingles: np.ndarray, pieces: int) -> np.ndarray:
    """Parity sketch of a set. The hash's upper half chooses the piece; 0 is an empty one."""
    piece = ((shingles >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    starts = np.searchsorted(piece, np.arange(pieces, dtype=np.uint64))
    out = np.bitwise_xor.reduceat(np.append(shingles, np.uint64(0)), starts)
    out[np.append(starts[1:], len(shingles)) == starts] = 0
    return out


def shingle_sets(docs: DataFrame, like: Likeness, key: str, text: str) -> DataFrame:
    """One row a document: a hash of its text, size and digest of its set, and its sketches for its own band and the next."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    schema = "doc_id long, version long, n long, d1 long, d2 long, band int, own binary, next binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, piece_counts = Shingler(like.words), {}

        def pieces(b: int) -> int:
            if b not in piece_counts:
                piece_counts[b] = pieces_of_band(b, like.percent)[0]
            return piece_counts[b]

        for batch in batches:
            n, first, second, bands, own, above = [], [], [], [], [], []
            for value in batch.column(2).to_pylist():
                s = shingler(value)
                n.append(len(s))
                a, b = digest(s)
                first.append(a)
                second.append(b)
                k = band(len(s), like.percent) if len(s) else 0
                bands.append(k)
                own.append(sketch(s, pieces(k)).tobytes() if len(s) else None)
                above.append(sketch(s, pieces(k + 1)).tobytes() if len(s) else None)
            columns = [pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.int32())]
            columns += [pa.array(own, pa.binary()), pa.array(above, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "version", "n", "d1", "d2", "band", "own", "next"])

    return docs.mapInArrow(run, schema)


def piece_rows(sets: DataFrame, like: Likeness) -> DataFrame:
    """Rows (bucket, id) of all sketches: a hash of band, place and bits, and the set's digest.

    Equal sets give equal rows, of which a batch sends one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            _, rows = np.unique(ids, return_index=True)
            bands, own, above = batch.column(1).to_numpy(), batch.column(2), batch.column(3)
            keys, owners = [], []
            for r in rows:
                for b, sketch_ in ((bands[r], own[r].as_buffer()), (bands[r] + 1, above[r].as_buffer())):
                    b = int(b)
                    if b not in spare:
                        spare[b] = pieces_of_band(b, like.percent)[1]
                    bits = np.frombuffer(sketch_, np.uint64)
                    place = np.arange(len(bits), dtype=np.uint64) + (np.uint64(b) << np.uint64(40))
                    full = bits != 0
                    if len(bits) - np.count_nonzero(full) <= spare[b]:
                        bits, place = bits[full], place[full]
                    h = (bits ^ (place * np.uint64(ODD[0]))) * np.uint64(ODD[1])
                    h = (h ^ (h >> np.uint64(31))) * np.uint64(ODD[2])
                    keys.append(h ^ (h >> np.uint64(29)))
                    owners.append(np.full(len(bits), ids[r]))
            if keys:
                # Smaller outputs than one array for all: a batch may hold very long texts.
                keys, owners = np.concatenate(keys).view(np.int64), np.concatenate(owners)
                for at in range(0, len(keys), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 200_000]), pa.array(owners[at : at + 200_000])], names=["bucket", "id"])

    return sets.filter("n > 0").select("d1", "band", "own", "next").mapInArrow(run, "bucket long, id long")


def _rep(version: Column) -> Column:
    """What the text of a document is found by: its id, or without one a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), version.cast("string")))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rep`` and ``text`` of the documents in the one column of ``wanted``; equal texts without an id come once."""
    named = thinned(docs.withColumn("rep", _rep(F.xxhash64("text"))), "rep", wanted)
    return named.filter("doc_id is not null").select("rep", "text").unionByName(
        named.filter("doc_id is null").select("rep", "text").dropDuplicates(["rep"])
    )


#: Counters of how common shingles are; a fixed number, whatever the input.
COUNTERS = 1 << 18
#: Words of 64 bits of the parity sketch that goes with a set's rarest shingles.
SKETCH_WORDS = 4


def bit_sketch(shingles: np.ndarray) -> np.ndarray:
    """Each shingle flips one bit: two sketches differ in no more bits than their sets in shingles."""
    at = (shingles * np.uint64(ODD[3])) >> np.uint64(56)
    odd = np.bincount(at.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _narrowed(docs: DataFrame, classes: DataFrame, apart: DataFrame, like: Likeness) -> DataFrame:
    """Pairs of sets of different roots that may be alike: all that are, and few others.

    Shingles are ordered from the rarest among these sets, as a table of
    COUNTERS counts has it; any one order gives right results. Of two alike sets
    of ``n`` and ``m`` shingles, both have one in common among the first
    ``n - ceil(n * percent) + 1`` and ``m - ceil(m * percent) + 1``. Sets that
    have no more than a passage in common do not meet on it, as it is common;
    a shingle that only sets of one root have is left out before the join.
    The join lets no pair through whose bit sketches differ in more bits than
    alike sets of their sizes differ in shingles, so a large group of sets that
    are nearly alike makes few rows.
    """
    spark = docs.sparkSession
    held = apart.withColumnRenamed("id", "d1").join(classes.select("d1", "rep"), "d1")
    known = held.join(_texts(docs, held.select("rep")), "rep").select("d1", "root", "text")
    known = settle(spark, known.repartition(shuffle_width(spark), "d1"), "apart")
    shingled = known.select("d1", "root", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sums = Shingler(like.words), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(2).to_pylist():
                np.add.at(sums, (shingler(text) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["counter", "n"])

    counted = shingled.mapInArrow(count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    common = np.zeros(COUNTERS, np.int64)
    common[counted["counter"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(like.words)
        names = ["id", "root", "n", "rest", "hash", *[f"s{k}" for k in range(SKETCH_WORDS)]]
        for batch in batches:
            for meant, root, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingler(text)
                if not len(s) or digest(s)[0] != meant:
                    continue
                s = s[np.lexsort((s, common[(s % np.uint64(COUNTERS)).astype(np.int64)]))]
                n, bits = len(s), bit_sketch(s)
                head = s[: n - -(-n * like.percent // 100) + 1]
                same = lambda v: pa.array(np.full(len(head), v, np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [same(meant), same(root), same(n), pa.array(n - np.arange(len(head), dtype=np.int64)), pa.array(head.view(np.int64)), *map(same, bits)],
                    names=names,
                )

    sketched = ", ".join(f"s{k} long" for k in range(SKETCH_WORDS))
    rows = settle(spark, shingled.mapInArrow(heads, f"id long, root long, n long, rest long, hash long, {sketched}").dropDuplicates(["id", "hash"]), "heads")
    mixed = rows.groupBy("hash").agg(F.min("root").alias("_x"), F.max("root").alias("_y")).filter("_x <> _y").select("hash")
    keyed = rows.join(mixed, "hash")
    x, y = keyed.alias("x"), keyed.alias("y")
    sized = like.percent * F.greatest("x.n", "y.n") <= 100 * F.least("x.n", "y.n")
    # From the first shingle in common on, both sets must hold all that alike sets share.
    enough = (100 + like.percent) * F.least("x.rest", "y.rest") >= like.percent * (F.col("x.n") + F.col("y.n"))
    differ = F.lit(0)
    for k in range(SKETCH_WORDS):
        differ = differ + F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}")))
    near = (100 + like.percent) * differ <= (100 - like.percent) * (F.col("x.n") + F.col("y.n"))
    may = (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & sized & enough & near
    return x.join(y, (F.col("x.hash") == F.col("y.hash")) & may).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """Links among candidate pairs (a, b) of set digests.

    Texts of the classes' first documents move to their pairs; whether a text
    is the one meant shows by its digest.
    """
    spark = docs.sparkSession
    side = lambda s: classes.select(F.col("d1").alias(s), F.col("n").alias(f"n_{s}"), F.col("rep").alias(f"rep_{s}"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    sized = 100 * F.least(n_a, n_b) >= like.percent * F.greatest(n_a, n_b)
    named = settle(spark, pairs.join(side("a"), "a").join(side("b"), "b").filter(sized), "candidates")
    texts = _texts(docs, named.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")))
    left = named.join(texts.select(F.col("rep").alias("rep_a"), F.col("text").alias("text_a")), "rep_a")
    both = left.join(texts.select(F.col("rep").alias("rep_b"), F.col("text").alias("text_b")), "rep_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(like.words)
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(meant: int, text: str) -> np.ndarray | None:
            s = held.get(meant)
            if s is None:
                s = shingler(text)
                if digest(s)[0] != meant:
                    return None
                held[meant] = s
                if len(held) > 64:
                    held.popitem(last=False)
            return s

        for batch in batches:
            out = []
            for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = shingles(a, text_a), shingles(b, text_b)
                if x is not None and y is not None:
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * same >= like.percent * (len(x) + len(y) - same):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def near_classes(docs: DataFrame, like: Likeness = Likeness(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents connected by similar shingle sets: ``doc_id``, ``n_shingles``, ``component_id``.

    Words are cut at ASCII white space and A-Z is lower-cased. A document with
    fewer words than a shingle has its whole text as one; one without words
    (or NULL) is empty and linked with nothing. ``component_id`` is the
    smallest id that links reach. A NULL id is carried along and never the
    smallest; rows that share an id are told apart by their texts. Every row
    of the input has one in the result; an empty table gives an empty one.

    Equal sets are one class from the start. Sets that share a piece are a
    bucket of candidates (see ``bucket_components``). A group of near copies is
    spread over as many buckets as a sketch has pieces, so a bucket holds a
    small share of all rows even if the group is a third of them; a bucket's
    rows are two numbers and stream through a sort. Members of a bucket that are
    not connected yet are compared by their rarest shingles. Sets go by 64 bits of their
    digest while candidates are searched; links are verified on the shingles.
    """
    return _classes(docs, like, key, text).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _classes(docs: DataFrame, like: Likeness, key: str, text: str) -> DataFrame:
    """``near_classes`` with a hash of each row's text, ``version``, and its ``root``, NULL for a row without words."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = settle(spark, shingle_sets(docs, like, "doc_id", "text"), "shingle-sets")
    first = F.min_by(F.struct("doc_id", "version"), F.struct(F.col("doc_id").isNull(), "doc_id", "version"))
    classes = sets.filter("n > 0").groupBy("n", "d1", "d2").agg(first.alias("_f")).select("n", "d1", "d2", "_f.*")
    classes = settle(spark, classes.withColumn("rep", _rep(F.col("version"))).drop("version"), "classes")
    found = bucket_components(
        spark, piece_rows(sets, like), lambda pairs: _verified(docs, classes, pairs, like), "ngram-join", lambda apart: _narrowed(docs, classes, apart, like), small=0
    )
    grouped = classes.join(found.withColumnRenamed("id", "d1"), "d1", "left").withColumn("root", F.coalesce("root", "d1"))
    least = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = grouped.join(least, "root").select("n", "d1", "d2", "component_id", "root")
    return sets.select("doc_id", "version", "n", "d1", "d2").join(linked, ["n", "d1", "d2"], "left").drop("d1", "d2")


def without_near_copies(docs: DataFrame, like: Likeness, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with one document of each class, the one of the smallest id.

    Documents without words are no one's copies and all stay, as do rows with a
    NULL id. Of rows that share id and class one stays.
    """
    found = _classes(docs, like, key, text).filter("root is not null and doc_id is not null")
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("_kept"))
    others = found.join(kept, "root").filter(F.struct("doc_id", "version") != F.col("_kept"))
    gone = others.select(F.col("doc_id").alias("_gone"), F.col("version").alias("_version")).distinct()
    version = F.xxhash64(text)
    stay = docs.join(gone, (F.col(key).cast("long") == F.col("_gone")) & (version == F.col("_version")), "left_anti")
    repeat = F.row_number().over(W.partitionBy(F.col(key), version).orderBy(F.xxhash64(*docs.columns)))
    wordless = F.coalesce(F.col(text), F.lit("")).rlike("^[ \\t-\\r]*$")
    return stay.withColumn("_repeat", F.when(F.col(key).isNull() | wordless, F.lit(1)).otherwise(repeat)).filter("_repeat = 1").drop("_repeat")
