"""Fill-in-the-middle forms of texts, cut between words.

A text's cuts are given as numbers of units (a word with the white space before
it, and white space at the end). Where unit ``k`` ends is found with a Fenwick
tree over blocks of a fixed number of bytes: each node holds how many units end
and how many code points begin in its blocks, a descent by binary lifting finds
the block of the cut in as many steps as the number of blocks has binary
digits, and only that block is then looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import extended

#: Bytes of a text block.
BLOCK = 4096
#: Bytes of texts in one batch handed back.
SENT = 8 << 20


@dataclass(frozen=True)
class Middles:
    """Which texts are rearranged and how.

    ``seed`` goes before the key in the hash that decides; of 100 texts
    ``plain`` stay as they are, and of 100 others ``suffix_first`` put the
    suffix first. The signs must not begin inside one another.
    """

    seed: int = 42
    plain: int = 50
    suffix_first: int = 80
    prefix: bytes = b"<P>"
    suffix: bytes = b"<S>"
    middle: bytes = b"<M>"


class BlockTree:
    """Fenwick tree of (unit ends, code points) over the blocks of one text in UTF-8."""

    def __init__(self, raw: bytes, block: int = BLOCK) -> None:
        b = np.frombuffer(raw, np.uint8)
        self.block, self.size = block, len(b)
        word = (b != 32) & ((b < 9) | (b > 13))
        self.ends = np.ones(len(b), bool)
        self.ends[:-1] = word[:-1] & ~word[1:]  # a word's last byte; the last byte of all ends the last unit
        self.begins = (b & 0xC0) != 0x80
        if not len(b):
            self.units = self.chars = [0]
            self.n = 0
            return
        starts = np.arange(0, len(b), block)
        units = [0, *np.add.reduceat(self.ends, starts, dtype=np.int64).tolist()]
        chars = [0, *np.add.reduceat(self.begins, starts, dtype=np.int64).tolist()]
        self.n = sum(units)
        for i in range(1, len(units)):
            up = i + (i & -i)
            if up < len(units):
                units[up] += units[i]
                chars[up] += chars[i]
        self.units, self.chars = units, chars

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the end of unit ``k`` (from 1; 0 is the start of the text)."""
        if k <= 0:
            return 0, 0
        at, chars, left = 0, 0, k
        step = 1 << ((len(self.units) - 1).bit_length() - 1)
        while step:
            after = at + step
            if after < len(self.units) and self.units[after] < left:
                at, left, chars = after, left - self.units[after], chars + self.chars[after]
            step >>= 1
        first = at * self.block
        end = first + int(np.flatnonzero(self.ends[first : first + self.block])[left - 1]) + 1
        return end, chars + int(np.count_nonzero(self.begins[first:end]))


def choices(key: str, seed: int) -> list[int]:
    """The four numbers that decide about a text: the first digits of a hash, eight by eight."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(raw: bytes, key: str, how: Middles = Middles(), block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and the text in its form."""
    tree = BlockTree(raw, block)
    h1, h2, h3, h4 = choices(key, how.seed)
    if not raw or h3 % 100 >= how.plain or how.prefix in raw or how.suffix in raw or how.middle in raw:
        return tree.n, "plain", None, None, raw
    first, last = sorted((h1 % (tree.n + 1), h2 % (tree.n + 1)))
    (a, a_chars), (b, b_chars) = tree.cut(first), tree.cut(last)
    before, within, behind = raw[:a], raw[a:b], raw[b:]
    if h4 % 100 < how.suffix_first:
        form, out = "spm", how.suffix + behind + how.prefix + before + how.middle + within
    else:
        form, out = "psm", how.prefix + before + how.suffix + behind + how.middle + within
    return tree.n, form, a_chars, b_chars - a_chars, out


def restored(out: bytes, form: str, how: Middles = Middles()) -> bytes:
    """The text that a form was made of, from the form alone."""
    if form == "plain":
        return out
    signs = (how.suffix, how.prefix) if form == "spm" else (how.prefix, how.suffix)
    one, rest = out[len(signs[0]) :].split(signs[1], 1)
    two, within = rest.split(how.middle, 1)
    before, behind = (two, one) if form == "spm" else (one, two)
    return before + within + behind


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", how: Middles = Middles()) -> DataFrame:
    """Add ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and ``restored`` to every row.

    Which texts are rearranged, where they are cut and which part comes first
    follow from a hash of the key alone. A NULL text is empty, and an empty
    text is plain, as is one that holds a sign. ``restored`` is rebuilt from
    output and form. A NULL key counts as an empty one; rows of one key and
    text get the same form. Other columns are kept, those of these names
    replaced. Whole texts of any length, no shuffle; output is handed back in
    batches of bounded size.
    """
    made = ("n", "form", "prefix_chars", "middle_chars", "output", "restored")
    keep = [c for c in docs.columns if c not in made or c in (key, text)]
    given = docs.select(*keep)
    docs = docs.select(*keep, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_fim_key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_fim_raw"))
    names = [f"_fim_{c}" for c in made]
    types = ("long", "string", "long", "long", "binary", "binary")
    schema = extended(given, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.num_columns - 2)
            texts = batch.column(batch.num_columns - 1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + SENT, side="right")))
                rows = []
                for k, raw in zip(keys.slice(at, end - at).to_pylist(), texts.slice(at, end - at).to_pylist()):
                    row = rearranged(raw, k, how)
                    rows.append((*row, restored(row[4], row[1], how)))
                out = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                kept = batch.slice(at, end - at).columns[:-2]
                yield pa.RecordBatch.from_arrays([*kept, *out], names=[*batch.schema.names[:-2], *names])
                at = end

    found = docs.mapInArrow(run, schema)
    last = [F.col(n).cast("string").alias(c) if c in ("output", "restored") else F.col(n).alias(c) for n, c in zip(names, made)]
    return found.select(*[c for c in keep if c not in made], *last)
