"""Token counts by the whole-token shortcut.

Most words of a text are one token each. Which strings of the vocabulary are
one token when they stand alone is proved once per task with the library
itself: every piece is encoded and kept only if it comes back whole. A text is
cut where no vocabulary piece can reach across, every part that is a proved
string counts one, and only the other parts go through the merge rules.

Where a text may be cut follows from the model and is checked against it: the
model puts one space before a text, writes a space as the sign U+2581 and has
no piece with that sign behind another character, so a merge can never join
the end of a word to the spaces before the next. A model for which this does
not hold, and a text that itself holds U+2581, are encoded as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from parley.llm.common import extended

SPACE_SIGN = "▁"
SPACED = re.compile(" +[^ ]*")
#: Parts longer than this are merged each time they come; shorter ones are remembered.
REMEMBERED_CHARS = 64
#: Distinct parts remembered at once in a task; then the memory starts afresh.
REMEMBERED_PARTS = 400_000


def whole_tokens(model) -> dict[str, int] | None:
    """Words that the vocabulary holds with their space and that encode alone as that one token.

    None if the model has a piece that reaches across a space, or treats
    spaces in another way than the cut relies on.
    """
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE_SIGN in p[1:] and p.strip(SPACE_SIGN) for p in pieces):
        return None
    one, run = model.encode("a"), model.encode("  b")
    if model.encode("a   b") != one + run or model.encode("a a") != one + one:
        return None
    words = [(p[1:], i) for i, p in enumerate(pieces) if p[0] == SPACE_SIGN and p[1:].strip(SPACE_SIGN)]
    encoded = model.encode([w for w, _ in words], num_threads=1)
    return {w: 1 for (w, i), ids in zip(words, encoded, strict=True) if ids == [i]}


class _Merged(dict):
    """Part of a text, without its first space, to its number of tokens.

    Holds the proved words and asks the model for other parts.
    """

    def __init__(self, model, proved: dict[str, int]) -> None:
        # A sign with nothing behind it: a space at the end of a text.
        self.proved = proved | {"": len(model.encode("a ")) - len(model.encode("a"))}
        self.model = model
        super().__init__(self.proved)

    def __missing__(self, part: str) -> int:
        count = len(self.model.encode(part))
        if len(part) <= REMEMBERED_CHARS:
            if len(self) > REMEMBERED_PARTS + len(self.proved):
                self.clear()
                self.update(self.proved)
            self[part] = count
        return count


class Counter:
    """Counts the tokens of texts with one sentencepiece model."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proved = whole_tokens(self.model)
        self.parts = None if proved is None else _Merged(self.model, proved)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.parts is None or SPACE_SIGN in text:
            return len(self.model.encode(text))
        parts = text.split(" ")
        if "" in parts:  # runs of spaces, or spaces at an end
            parts = [p[1:] for p in SPACED.findall(" " + text)]
        return sum(map(self.parts.__getitem__, parts))


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row.

    The other columns are kept, but for columns that already have one of these
    names. NULL and empty texts count no bytes and no tokens. Whole texts are
    counted, whatever their length; one batch of rows is in memory at a time.
    No shuffle. ``model_file`` must be readable on the executors.
    """
    rest = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    docs = docs.select(*rest)
    schema = extended(docs, "n_bytes long, n_tokens long, over_limit boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model_file)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text))
            sizes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            counts = pa.array([counter.count(t) for t in texts.to_pylist()], pa.int64())
            columns = [*batch.columns, sizes, counts, pc.greater(counts, limit)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, schema)
