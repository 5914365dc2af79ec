"""Document fingerprints from closed syncmers.

A k-mer is a closed syncmer if the smallest of its s-mers is its first or its
last one. Whether it is one depends on the k-mer alone, not on the text around
it, so an edit changes the anchors inside it and no others, and the anchors
that stay keep their distances: texts can be matched by position.

A fingerprint is a bottom sketch of a text's anchors: those of the smallest
hashes, each with its place. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import extended, shuffle_width

MIX_1, MIX_2, BASE = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Anchors:
    """Lengths of k-mers and of their inner s-mers, and anchors kept in a fingerprint."""

    k: int = 16
    s: int = 8
    kept: int = 128


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` codes, by doubling: two halves make a whole."""
    if n == 1:
        return _mixed(codes * np.uint64(BASE))
    half = _grams(codes, n // 2)
    out = half[: len(half) - (n - n // 2)] * np.uint64(BASE) + half[n // 2 : len(half) - (n - n // 2) + n // 2] if n % 2 == 0 else None
    if out is None:
        one = _mixed(codes[n - 1 :] * np.uint64(BASE))
        pair = half[: len(one)] * np.uint64(BASE) + half[n // 2 : n // 2 + len(one)]
        out = pair * np.uint64(BASE) + one
    return _mixed(out)


def syncmers(text: str, shape: Anchors = Anchors()) -> tuple[np.ndarray, np.ndarray]:
    """Places (code points) and 64-bit hashes of the closed syncmers of a text.

    A text without one, as any shorter than ``k``, is its own anchor at 0; an
    empty text has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    k, s = shape.k, shape.s
    if len(codes) >= k:
        small = _grams(codes, s)
        span = k - s  # the last inner s-mer begins here
        inner, width = small, 1
        while width * 2 <= span + 1:
            inner = np.minimum(inner[:-width], inner[width:])
            width *= 2
        if width < span + 1:
            inner = np.minimum(inner[: len(inner) - (span + 1 - width)], inner[span + 1 - width :])
        at = np.flatnonzero((small[: len(inner)] == inner) | (small[span : span + len(inner)] == inner))
        if len(at):
            return at, _grams(codes, k)[at]
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    digest = hashlib.blake2b(codes.tobytes(), digest_size=8).digest()
    return np.zeros(1, np.int64), np.frombuffer(digest, np.uint64)


def sketch(text: str, shape: Anchors = Anchors()) -> np.ndarray:
    """The anchors kept of a text, ordered by hash: rows of (hash, place), 32 bits each.

    Of equal anchors the first counts. Whole texts are read.
    """
    at, hashes = syncmers(text, shape)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    if len(short) > 4 * shape.kept:
        # Only hashes that can be among the smallest: more may be needed if anchors repeat.
        want = shape.kept
        while want < len(short):
            want *= 2
            edge = np.partition(short, min(want, len(short)) - 1)[min(want, len(short)) - 1]
            near = np.flatnonzero(short <= edge)
            if len(np.unique(short[near])) >= shape.kept:
                short, at = short[near], at[near]
                break
    values, first = np.unique(short, return_index=True)
    return np.stack([values[: shape.kept], at[first[: shape.kept]].astype(np.uint32)], axis=1)


def fingerprint_text(anchors: np.ndarray) -> str:
    return base64.b64encode(anchors.astype("<u4").tobytes()).decode()


def fingerprint_anchors(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)


def matched(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places of the anchors that two sketches share, as the longest run in order in both."""
    shared, x, y = np.intersect1d(a[:, 0], b[:, 0], assume_unique=True, return_indices=True)
    if not len(shared):
        return []
    pairs = sorted(zip(a[x, 1].tolist(), b[y, 1].tolist()), key=lambda p: (p[0], -p[1]))
    ends: list[int] = []
    at_end: list[int] = []
    back: list[int] = []
    for n, (_, place) in enumerate(pairs):
        slot = bisect_left(ends, place)
        back.append(at_end[slot - 1] if slot else -1)
        if slot == len(ends):
            ends.append(place)
            at_end.append(n)
        else:
            ends[slot], at_end[slot] = place, n
    run, n = [], at_end[-1]
    while n >= 0:
        run.append(pairs[n])
        n = back[n]
    return run[::-1]


def likeness(a: np.ndarray, b: np.ndarray, shape: Anchors = Anchors()) -> float:
    """Share of the smallest anchors of both texts together that are in both, in order.

    An estimate of the Jaccard similarity of the anchor sets. 1 for equal
    sketches, so also for two empty texts; 0 if one text is empty.
    """
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    union = np.union1d(a[:, 0], b[:, 0])[: shape.kept]
    edge = union[-1]
    pairs = len(matched(a[a[:, 0] <= edge], b[b[:, 0] <= edge]))
    return min(1.0, pairs / len(union))


def fingerprints(docs: DataFrame, text: str = "text", shape: Anchors = Anchors()) -> DataFrame:
    """Add ``n_chars`` (code points) and ``fingerprint`` to every row.

    NULL counts as empty; an empty text has the empty fingerprint. Columns of
    these names are replaced, others kept. No shuffle.
    """
    keep = [c for c in docs.columns if c not in ("n_chars", "fingerprint")]
    docs = docs.select(*keep)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [t if isinstance(t, str) else "" for t in pdf[text]]
            pdf["n_chars"] = [len(t) for t in texts]
            pdf["fingerprint"] = [fingerprint_text(sketch(t, shape)) for t in texts]
            yield pdf

    return docs.mapInPandas(run, extended(docs, "n_chars long, fingerprint string"))


def anchors(docs: DataFrame, key: str = "doc_id", text: str = "text", shape: Anchors = Anchors()) -> DataFrame:
    """Every closed syncmer: one row (key, place, hash) each, for positional matching at full detail."""
    docs = docs.select(key, text)
    schema = extended(docs.select(key), "place long, hash long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for value, t in zip(pdf[key], pdf[text]):
                at, hashes = syncmers(t if isinstance(t, str) else "", shape)
                yield pd.DataFrame({key: pd.Series([value] * len(at), dtype=pdf[key].dtype), "place": at.astype("int64"), "hash": hashes.view("int64")})

    return docs.mapInPandas(run, schema)


def with_next(docs: DataFrame, order: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in ascending ``order`` cut into runs, each followed by the row after it.

    Returns ``run``, ``after`` (the row belongs to the next run), ``order`` and
    ``text``. Rows of one run are a task's work, sorted; the first row of all
    follows the last. Texts move once. Only bounds of the runs, one id each,
    reach the driver. NULL ids come first, ties are ordered by text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(order).cast("long").alias(order), text)
    ids = docs.select(order).filter(F.col(order).isNotNull())
    parts = shuffle_width(spark) * 2
    bounds = sorted(set(ids.approxQuantile(order, [n / parts for n in range(1, parts)], 0.25 / parts)))
    bounds = np.array([int(b) for b in bounds], np.int64)

    @F.pandas_udf("int")
    def run_of(values: pd.Series) -> pd.Series:
        placed = np.searchsorted(bounds, values.fillna(np.iinfo(np.int64).min).astype("int64"), side="right")
        return pd.Series(placed.astype("int32"))

    rows = docs.withColumn("run", run_of(order))
    least = (
        rows.select("run", F.coalesce(order, F.lit(-(2**63))).alias("least")).groupBy("run").agg(F.min("least").alias("least"))
    )
    firsts = sorted((r["run"], r["least"]) for r in least.collect())
    if not firsts:
        return rows.select("run", F.lit(False).alias("after"), order, text)
    # The first row of each run, by id and then by text, once more for the run before it.
    before = {first: firsts[n - 1][0] for n, (_, first) in enumerate(firsts)}
    target = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.coalesce(order, F.lit(-(2**63))))
    edge = F.col(order).isin(list(before)) | (F.col(order).isNull() & F.lit(firsts[0][1] == -(2**63)))
    heads = docs.filter(edge).groupBy(order).agg(F.min(text).alias(text)).withColumn("run", target.cast("int"))
    return rows.select("run", F.lit(False).alias("after"), order, text).unionByName(
        heads.select("run", F.lit(True).alias("after"), order, text)
    )


def compare_edited(docs: DataFrame, order: str = "doc_id", text: str = "text", shape: Anchors = Anchors()) -> DataFrame:
    """Fingerprint every text and an edited copy of it, and compare.

    The edit puts the first characters of the next text (ascending ``order``,
    after the last the first) in place of the last quarter, floor(n / 4) code
    points, or all of the next text if it is shorter. Returns ``order``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next``. NULL counts as empty. A single row is
    its own next row. Rows stream through a run's task in order, one Arrow
    batch at a time, with one row carried from batch to batch.
    """
    runs = with_next(docs, order, text)
    width = shuffle_width(docs.sparkSession)
    schema = f"{order} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]

    def compare(held: tuple, after: tuple) -> tuple:
        _, key, value, own = held
        cut = len(value) // 4
        edited = value[: len(value) - cut] + after[2][:cut]
        changed = own if edited == value else sketch(edited, shape)
        return (
            key,
            len(value),
            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            fingerprint_text(own),
            fingerprint_text(changed),
            likeness(own, changed, shape),
            likeness(own, after[3], shape),
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            out = []
            for number, after, key, value in zip(pdf["run"], pdf["after"], pdf[order], pdf[text]):
                value = value if isinstance(value, str) else ""
                row = (number, None if pd.isna(key) else int(key), value, sketch(value, shape))
                if held is not None and held[0] == number:
                    out.append(compare(held, row))
                held = None if after else row
            made = pd.DataFrame(out, columns=names)
            made[order] = made[order].astype("Int64")
            yield made

    ordered = runs.repartition(width, "run").sortWithinPartitions("run", "after", F.col(order).asc_nulls_first(), F.col(text).asc_nulls_first())
    return ordered.mapInPandas(run, schema)
