"""Alignment of two tokenizations of a text, from white space to white space.

A text is tokenized in full by both tokenizers. Where a token that begins with
a space starts in both at the same byte, both have just ended a token: an
anchor. Anchors cut the text into windows, mostly a word each, and a window's
alignment depends on its token ids alone, so it is worked out once for each
pair of id tuples and then looked up.

Two tokens are linked where their bytes end together, so the bytes of one are
an ending of the other's: there are at most as many id pairs as all entries of
both vocabularies have endings, some hundred thousand, whatever the corpus.
That is why the corpus-wide counts of id pairs can be sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import extended
from parley.llm.packing import ALIKE, ODD_SPACE, Ids
from parley.llm.token_counts import SPACE_SIGN
from parley.session import settle

#: Windows remembered at once in a task, and the tokens of the longest that is.
REMEMBERED, REMEMBERED_TOKENS = 100_000, 64
#: Bytes of texts tokenized together, and of groups in one batch handed back.
TOGETHER, SENT = 1 << 18, 2 << 20


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Left:
    """Ids of space + text under the byte-level tokenizer, special tokens read as plain text.

    The split pattern begins a new token at every space before a visible
    character. Where the second library reads the pattern alike, it encodes the
    whole text; else the words it may read in another way are encoded by the
    first one, each with its space.
    """

    def __init__(self, json_file: str, ranks_file: str | None) -> None:
        self.ids = Ids(json_file, ranks_file)
        self.ids.tokenizer.encode_special_tokens = True
        self.fast = self.ids.fast
        # Without a normalizer a byte-level tokenizer spells every text.
        self.exact = self.ids.tokenizer.normalizer is None

    def slow(self, text: str) -> list[int]:
        return self.ids.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and ALIKE(text):
            return np.asarray(self.fast.encode_to_numpy(" " + text), np.uint32)
        if self.fast is None or text[:1].isspace() or ODD_SPACE.search(text):
            return np.array(self.slow(" " + text), np.uint32)
        out: list[int] = []
        for alike, words in groupby(text.split(" "), lambda w: ALIKE(w) is not None):
            spaced = " " + " ".join(words)
            out += self.fast.encode_ordinary(spaced) if alike else self.slow(spaced)
        return np.array(out, np.uint32)


class Pair:
    """Both tokenizers, the bytes of their tokens, and the windows a task remembers."""

    def __init__(self, json_file: str, ranks_file: str | None, model_file: str) -> None:
        import sentencepiece

        self.left = Left(json_file, ranks_file)
        self.right = sentencepiece.SentencePieceProcessor(model_file=model_file)
        letters = byte_letters()
        vocabulary = self.left.ids.tokenizer.get_vocab(with_added_tokens=True)
        a: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.right.id_to_piece(i) for i in range(self.right.get_piece_size())]
        b = [bytes([int(p[3:5], 16)]) if self.right.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = a, b
        self.lengths = [np.array([len(t) for t in tokens], np.int64) for tokens in (a, b)]
        self.marked = [np.array([t[:1] == b" " for t in tokens]) for tokens in (a, b)]
        # How a token is written: within its group, at the end of its side, and, for the second side, at the end of its window.
        self.written = [f"{i}{sign}" for size, signs in ((len(a), ",|"), (len(b), ",;\n")) for sign in signs for i in range(size)]
        self.windows: dict[bytes, tuple[str, bytes]] = {}

    def aligned(self, texts: list[str]) -> list[tuple[int, int, str, bytes]]:
        """For each text the number of tokens of both, its groups and its links; nothing where a side does not spell the text."""
        spelled, ids = [], ([], [])
        for k, (text, right) in enumerate(zip(texts, self.right.encode(texts, num_threads=1))):
            raw = b" " + text.encode("utf-8", "surrogatepass")
            if text and b"".join(map(self.bytes[1].__getitem__, right)) == raw:
                left = self.left(text)
                if int(self.lengths[0][left].sum()) == len(raw) and (self.left.exact or b"".join(map(self.bytes[0].__getitem__, left.tolist())) == raw):
                    spelled.append(k)
                    ids[0].append(left)
                    ids[1].append(np.array(right, np.uint32))
        out = [(0, 0, "", b"")] * len(texts)
        if not spelled:
            return out
        flat, begins, starts, at = [np.concatenate(i) for i in ids], [], [], []
        for tokens, lengths, marked, parts in zip(flat, self.lengths, self.marked, ids):
            first = np.cumsum([0, *map(len, parts)])
            begin = np.cumsum(lengths[tokens]) - lengths[tokens]
            opens = marked[tokens]
            opens[first[:-1]] = True
            place = np.flatnonzero(opens)
            begins.append(first)
            at.append(place)
            starts.append(begin[place])
        # Windows begin where a token with a space, or a text, begins on both sides at the same byte.
        _, x, y = np.intersect1d(*starts, assume_unique=True, return_indices=True)
        edges = [np.append(place[i], len(tokens)) for place, i, tokens in zip(at, (x, y), flat)]
        # A window's key: ids of the first side, behind them those of the second, moved past all of the first.
        mixed = np.empty(len(flat[0]) + len(flat[1]), "<u4")
        sizes = [np.diff(e) for e in edges]
        mixed[np.arange(len(flat[0])) + np.repeat(edges[1][:-1], sizes[0])] = flat[0]
        mixed[np.arange(len(flat[1])) + np.repeat(edges[0][1:], sizes[1])] = flat[1] + np.uint32(len(self.bytes[0]))
        packed, cuts = mixed.tobytes(), (4 * (edges[0] + edges[1])).tolist()
        keys = [packed[i:j] for i, j in zip(cuts, cuts[1:])]
        met = list(map(self.windows.get, keys))
        new = {key: n for n, (key, found) in enumerate(zip(keys, met)) if found is None}
        if new:
            made = dict(zip(new, self.align_windows(flat, edges, np.fromiter(new.values(), np.int64, len(new)))))
            met = [made[key] if found is None else found for key, found in zip(keys, met)]
            if len(self.windows) + len(made) > REMEMBERED:
                self.windows.clear()
            if len(made) > REMEMBERED or len(max(made, key=len)) > 4 * REMEMBERED_TOKENS:
                made = dict(islice(((k, v) for k, v in made.items() if len(k) <= 4 * REMEMBERED_TOKENS), REMEMBERED))
            self.windows.update(made)
        window = np.searchsorted(edges[0], begins[0]).tolist()
        for n, k in enumerate(spelled):
            groups = met[window[n] : window[n + 1]]
            out[k] = len(ids[0][n]), len(ids[1][n]), ";".join([g for g, _ in groups]), b"".join([c for _, c in groups])
        return out

    def align_windows(self, flat: list[np.ndarray], edges: list[np.ndarray], chosen: np.ndarray) -> list[tuple[str, bytes]]:
        """Groups of each chosen window, and the codes of the pairs of tokens that end them; all windows in one go."""
        sides = []
        for tokens, edge in zip(flat, edges):
            sizes = edge[chosen + 1] - edge[chosen]
            until = np.cumsum(sizes)
            sides.append((tokens[np.repeat(edge[chosen] - (until - sizes), sizes) + np.arange(until[-1])].astype(np.int64), until))
        (a, a_until), (b, b_until) = sides
        # Both sides of a window spell the same bytes, so ends can be compared across all windows.
        _, a_end, b_end = np.intersect1d(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]), assume_unique=True, return_indices=True)
        first, second = len(self.bytes[0]), len(self.bytes[1])
        codes = (a[a_end] * second + b[b_end]).astype("<i8").tobytes()
        a_sign, b_sign = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_sign[a_end], b_sign[b_end] = 1, 1
        b_sign[b_until - 1] = 2
        order = np.empty(len(a) + len(b), np.int64)
        a_group, b_group = np.cumsum(a_sign) - a_sign, np.cumsum(b_sign > 0) - (b_sign > 0)
        order[np.arange(len(a)) + np.append(0, b_end + 1)[a_group]] = a + a_sign * first
        order[np.arange(len(b)) + (a_end + 1)[b_group]] = 2 * first + b + b_sign * second
        groups = "".join(map(self.written.__getitem__, order.tolist())).split("\n")
        cuts = (8 * np.append(0, np.searchsorted(a_end, a_until - 1, side="right"))).tolist()
        return [(g, codes[i:j]) for g, i, j in zip(groups, cuts, cuts[1:])]


def align(docs: DataFrame, json_file: str, ranks_file: str | None, model_file: str, text: str = "text") -> DataFrame:
    """Add ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` and ``links`` to every row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of both sides between places where
    both end a token. ``links`` has a code for each pair of tokens whose bytes
    end together: id of the first times the size of the second vocabulary plus
    id of the second. Special tokens are plain text. NULL and empty texts, and
    texts that the tokens of one side do not spell, have no tokens: zeros, an
    empty string and an empty array. Other columns are kept, those of these
    names replaced. Whole texts, no shuffle; a task holds one batch of texts
    and the bounded memories.
    """
    made = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups": "string", "links": "array<long>"}
    keep = [c for c in docs.columns if c not in made or c == text]
    given = docs.select(*keep)
    names = [f"_align_{c}" for c in made]
    schema = extended(given, ", ".join(f"{n} {t}" for n, t in zip(names, made.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(json_file, ranks_file, model_file)

        def made_of(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
            counts = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            offsets = np.cumsum([0, *[r[3] for r in rows]]).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join([r[5] for r in rows]), "<i8")))
            out = [*counts, pa.array([r[4] for r in rows], pa.string()), links]
            return pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *names])

        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + TOGETHER, side="right")))
                part = batch.slice(at, end - at)
                read = [t or "" for t in texts.slice(at, end - at).to_pylist()]
                rows, first, size = [], 0, 0
                for n, (a, b, shown, codes) in enumerate(pair.aligned(read)):
                    rows.append((a, b, shown.count("|"), len(codes) // 8, shown, codes))
                    size += len(shown)
                    if size >= SENT:
                        yield made_of(part.slice(first, len(rows)), rows)
                        rows, first, size = [], n + 1, 0
                if rows:
                    yield made_of(part.slice(first, len(rows)), rows)
                at = end

    found = given.mapInArrow(run, schema)
    return found.select(*[c for c in keep if c not in made], *[F.col(n).alias(c) for n, c in zip(names, made)])


def link_counts(aligned: DataFrame, width: int) -> DataFrame:
    """How many links of the whole table hold each id pair: a, b, count. ``width`` is the size of the second vocabulary."""
    codes = aligned.select(F.explode("links").alias("code")).groupBy("code").agg(F.count("*").alias("count"))
    return codes.select(F.expr(f"code div {width}").alias("a"), (F.col("code") % width).alias("b"), "count")


def with_link_statistics(aligned: DataFrame, width: int) -> DataFrame:
    """Replace ``links`` by ``n_best`` and ``count_sum``.

    ``count_sum`` adds up the counts of a row's links; ``n_best`` is how many
    of them have the highest count of their second id, ties included.
    ``aligned`` is read twice, so it should be a table. The counts, bounded by
    the vocabularies as the module's text says, go through the driver to all
    tasks.
    """
    rows = link_counts(aligned, width).toPandas()
    code = (rows["a"] * width + rows["b"]).to_numpy(np.int64)
    by = np.argsort(code)
    code, count, b = code[by], rows["count"].to_numpy(np.int64)[by], rows["b"].to_numpy(np.int64)[by]
    most = np.zeros(width, np.int64)
    np.maximum.at(most, b, count)
    best = (count == most[b]).astype(np.int64)
    keep = [c for c in aligned.columns if c not in ("n_best", "count_sum")]
    schema = extended(aligned.select(*[c for c in keep if c != "links"]), "n_best long, count_sum long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = batch.column(batch.schema.names.index("links"))
            place = np.searchsorted(code, pc.list_flatten(links).to_numpy(zero_copy_only=False))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(links), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            sums = []
            for values in (best, count):
                total = np.concatenate([[0], np.cumsum(values[place])])
                sums.append(pa.array(np.diff(total[np.concatenate([[0], ends])]), pa.int64()))
            kept = [batch.column(n) for n, c in enumerate(batch.schema.names) if c != "links"]
            yield pa.RecordBatch.from_arrays([*kept, *sums], names=schema.names)

    return aligned.select(*keep).mapInArrow(run, schema)


def vocabulary_sizes(json_file: str, model_file: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(json_file).get_vocab().values()) + 1, sentencepiece.SentencePieceProcessor(model_file=model_file).get_piece_size()


def alignment_report(docs: DataFrame, json_file: str, ranks_file: str | None, model_file: str, text: str = "text") -> DataFrame:
    """Align every row and compare its links with the corpus: groups become their digest, links their statistics.

    Adds ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256`` (empty
    without tokens), ``n_best`` and ``count_sum``; texts are dropped. Texts are
    tokenized once; what is written in between are codes of links, four bytes
    each where both vocabularies allow it.
    """
    aligned = align(docs, json_file, ranks_file, model_file, text)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    keep = [c for c in docs.columns if c in aligned.columns and c not in (text, "n_a", "n_b", "n_groups", "n_links", "groups", "links", "groups_sha256")]
    first, second = vocabulary_sizes(json_file, model_file)
    links = F.col("links").cast("array<int>") if first * second < 2**31 else F.col("links")
    rows = aligned.select(*keep, "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), links.alias("links"))
    return with_link_statistics(settle(docs.sparkSession, rows, "links"), second)
