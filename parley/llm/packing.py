"""Best-fit packing of documents into sequences by bin completion.

A sequence is a bin. What matters about a piece is its length alone, and there
are at most as many lengths as a sequence has tokens, so the plan is made on
the histogram of lengths: a table of fixed size, whatever the corpus. Bin
completion takes the largest length left, enumerates the fillings of the rest
of its sequence that no other filling dominates, tries the best first and
backtracks within a bound on the waste, with a best-fit solution as the first
incumbent. The pieces then find their sequence in the plan by their rank among
the pieces of their length; ranks are counted in parallel.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.common import extended
from parley.session import settle

#: Fillings looked at for one sequence, and sequences kinds opened in the whole search.
FILLINGS, NODES = 400, 20_000
#: Distinct words remembered at once in a task.
REMEMBERED_WORDS = 400_000
#: Rows ranked in one task.
RANKED_ROWS = 200_000

# Words on which the two tokenizer libraries read the split pattern alike:
# printable ASCII, line feeds and the letters of U+00C0 to U+024F without the
# multiplication and division signs. Any other word goes to the reference
# library itself.
ALIKE = re.compile("[\x20-\x7e\nÀ-ÖØ-öø-ɏ]*").fullmatch
ODD_SPACE = re.compile(r" (?=\s|$)|^ ")


class Ids:
    """Token ids of texts as packed little-endian 32-bit numbers.

    The split pattern begins a new token at every space before a visible
    character, so a text is the ids of its words one after another, each word
    with the space before it; words seen before are looked up. Texts with
    runs of spaces or with the text of a special token are encoded as a whole.
    """

    def __init__(self, json_file: str, ranks_file: str | None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_file)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        self.fast = None
        if ranks_file:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first, self.later = _Words(self, ""), _Words(self, " ")

    def encode(self, text: str) -> bytes:
        if self.fast is not None and ALIKE(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def __call__(self, text: str) -> bytes:
        if self.special(text):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        if ODD_SPACE.search(text):
            return self.encode(text)
        words = text.split(" ")
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))


class _Words(dict):
    def __init__(self, ids: Ids, space: str) -> None:
        super().__init__()
        self.ids, self.space = ids, space

    def __missing__(self, word: str) -> bytes:
        packed = self.ids.encode(self.space + word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = packed
        return packed


def token_pieces(docs: DataFrame, json_file: str, ranks_file: str | None = None, capacity: int = 1024, end_id: int = 2, text: str = "text") -> DataFrame:
    """Tokenize every row and cut what does not fit into one sequence.

    A row's ids are those of its text and then ``end_id``; a NULL text is
    empty. Rows of at most ``capacity`` ids are one piece; of longer ones the
    first piece takes what the full pieces behind it leave. Adds ``piece``,
    ``start``, ``length`` and ``ids_crc32`` and drops the text.
    """
    keep = [c for c in docs.columns if c not in (text, "piece", "start", "length", "ids_crc32")]
    schema = extended(docs.select(*keep), "piece int, start long, length long, ids_crc32 long")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(json_file, ranks_file)
        for batch in batches:
            rows, pieces, starts, lengths, crcs = [], [], [], [], []
            for row, value in enumerate(batch.column(0).to_pylist()):
                packed = (ids(value) if value else b"") + end
                n = len(packed) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(row)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(packed[4 * a : 4 * b]))
            at = pa.array(rows, pa.int64())
            made = [pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs))]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[1:]), *made], names=schema.names)

    return docs.select(text, *keep).mapInArrow(run, schema)


def _fillings(room: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, ...]]:
    """Fillings of ``room`` that leave the least, none dominated by another.

    One length that fills as much dominates any set that can be put in its
    place, so lengths are tried from the largest down, and a set is dropped if
    a further length left over would still fit. At most ``FILLINGS`` sets are
    looked at; a perfect one ends the search.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    looked = 0

    def extend(room: int, high: int, chosen: tuple[int, ...]) -> bool:
        nonlocal looked
        at = bisect_right(lengths, min(room, high)) - 1
        fits = False
        while at >= 0 and looked < FILLINGS:
            n = lengths[at]
            if counts[n] > chosen.count(n):
                fits = True
                looked += 1
                if n == room:
                    found.append((0, (*chosen, n)))
                    return True
                if extend(room - n, n, (*chosen, n)):
                    return True
            at -= 1
        if not fits:
            found.append((room, chosen))
        return False

    extend(room, room, ())
    best: dict[tuple[int, ...], int] = {}
    for waste, chosen in sorted(found, key=lambda f: (f[0], len(f[1]))):
        best.setdefault(chosen, waste)
        if len(best) == 3:
            break
    return list(best)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Lower bound on the sequences: the tokens over the capacity, or the pieces
    over half of it plus what the rest needs beyond the room those leave."""
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    for least in (n for n in counts if 2 * n <= capacity):
        large = sum(c for n, c in counts.items() if n > capacity - least)
        middle = {n: c for n, c in counts.items() if capacity - least >= n > capacity / 2}
        small = sum(n * c for n, c in counts.items() if least <= n <= capacity / 2)
        room = sum((capacity - n) * c for n, c in middle.items())
        bound = max(bound, large + sum(middle.values()) + max(0, -(-(small - room) // capacity)))
    return bound


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for a histogram of lengths: (lengths of a sequence, how many of it).

    Branch and bound over kinds of sequences. The first descent takes the best
    completion each time, which is best fit with sets in place of single
    pieces. Further descents differ from it, latest choice first, and are cut
    when their waste shows that they cannot beat the incumbent. The search
    stops at the lower bound or after ``NODES`` kinds.
    """
    total = sum(n * c for n, c in counts.items())
    bound = least_bins(counts, capacity)
    best: list[tuple[tuple[int, ...], int]] = []
    best_bins = None
    opened = 0
    # A branch: what is left, the kinds chosen so far, their bins and their waste.
    branches = [(dict(counts), [], 0, 0, None)]
    while branches and opened < NODES and best_bins != bound:
        left, kinds, bins, waste, first = branches.pop()
        left, kinds = dict(left), list(kinds)
        lengths = sorted(n for n, c in left.items() if c)
        while lengths:
            if best_bins is not None and waste > (best_bins - 1) * capacity - total:
                break
            opened += 1
            top = lengths[-1]
            left[top] -= 1
            options = [first] if first else _fillings(capacity - top, lengths, left)
            left[top] += 1
            if not first:
                for other in options[:0:-1]:
                    if len(branches) < 64:
                        branches.append((dict(left), list(kinds), bins, waste, other))
            first = None
            kind = (top, *options[0])
            times = min(left[n] // kind.count(n) for n in set(kind))
            for n in kind:
                left[n] -= times
            kinds.append((kind, times))
            bins += times
            waste += times * (capacity - sum(kind))
            lengths = [n for n in lengths if left[n]]
        else:
            if best_bins is None or bins < best_bins:
                best, best_bins = kinds, bins
    return best


def _parts(pieces: DataFrame, groups: int, order: Sequence[str]) -> Column:
    """A number of about ``groups`` for each piece: by a hash, or by spans of the first of ``order``."""
    if not order:
        return F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    last = pieces.agg(F.max(order[0])).first()[0] or 0
    return F.floor(F.col(order[0]) / F.lit(-(-(last + 1) // groups))).cast("int")


def _ranked(pieces: DataFrame, groups: int, order: Sequence[str] = ()) -> DataFrame:
    """Add ``rank``, the gapless place of a piece among those of its length.

    Each length is counted in ``groups`` parts, so that a length that a third
    of all pieces have is not ranked in one task.
    """
    parted = pieces.withColumn("part", _parts(pieces, groups, order))
    counts = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = W.partitionBy("length", "part").orderBy(*order, "doc_id", "piece")
    return parted.withColumn("n", F.row_number().over(place)).join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("n") - 1).drop("part", "n", "before")


def _in_order(packed: DataFrame, groups: int, order: Sequence[str]) -> DataFrame:
    """Number the sequences anew, by the place of their first piece in ``order``. Parts are counted as in ``_ranked``."""
    heads = packed.filter("offset = 0").select("sequence_id", *order).withColumn("part", _parts(packed, groups, order))
    counts = heads.groupBy("part").agg(F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(*order, "sequence_id"))
    numbered = heads.withColumn("n", place).join(starts, "part").select("sequence_id", (F.col("before") + F.col("n") - 1).alias("_number"))
    return packed.join(numbered, "sequence_id").select(*[F.col("_number").alias(c) if c == "sequence_id" else c for c in packed.columns])


def pack(pieces: DataFrame, capacity: int = 1024, order: Sequence[str] = ()) -> DataFrame:
    """Give every piece its ``sequence_id`` and its ``offset`` there.

    ``pieces`` has ``doc_id``, ``piece``, ``length`` (1 to ``capacity``) and
    ``ids_crc32`` and is read three times, so it should be a table. Every piece
    is packed once, none is cut. Repeated rows are packed like any others, an
    empty table gives an empty result. The histogram has at most ``capacity``
    rows, whatever the input; it is all that reaches the driver, and the plan
    that goes back has one row for each length.

    With ``order``, columns of which the first counts from 0, pieces of a
    length are taken in that order, and sequences are numbered by the place of
    their first piece.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first, used, of_length = 0, dict.fromkeys(counts, 0), {n: [] for n in counts}
    for kind, times in plan(counts, capacity):
        offset = 0
        for n in sorted(set(kind), reverse=True):
            each = kind.count(n)
            of_length[n].append((used[n], first, each, offset))
            used[n] += times * each
            offset += n * each
        first += times
    schema = "length long, runs array<struct<rank:long,bin:long,each:int,offset:long>>"
    looked_up = spark.createDataFrame([(n, runs) for n, runs in of_length.items()], schema)
    rows = max(1, sum(counts.values()))
    groups = -(-rows // RANKED_ROWS)
    placed = _ranked(pieces, groups, order).join(F.broadcast(looked_up), "length")
    run: Column = F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("rank")), -1)
    within = F.col("rank") - F.col("run.rank")
    packed = (
        placed.withColumn("run", run)
        .withColumn("sequence_id", F.col("run.bin") + F.floor(within / F.col("run.each")))
        .withColumn("offset", F.col("run.offset") + F.pmod(within, F.col("run.each")) * F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )
    if not order:
        return packed
    return _in_order(settle(spark, packed, "packed"), groups, order)


def pack_documents(docs: DataFrame, json_file: str, ranks_file: str | None = None, capacity: int = 1024, end_id: int = 2, order: Sequence[str] = ()) -> DataFrame:
    """Tokenize, cut and pack: one row a piece. Texts are tokenized once and only lengths are kept."""
    pieces = settle(docs.sparkSession, token_pieces(docs.select("doc_id", "text", *order), json_file, ranks_file, capacity, end_id), "pieces")
    return pack(pieces, capacity, order)
