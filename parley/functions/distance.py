"""Word edit distance between texts of single-blank separated tokens.

Pairs go to Python in Arrow batches: a bit-parallel count, whose cost grows
with n*m/64, and for the kinds of edits the part of the alignment table that
the count and the numbers of each token prove wide enough, filled for all pairs
of a batch together. Where these bounds leave one answer, the table is not
filled; texts that only lost, only gained or only exchanged words are counted
in one pass. Whole strings cross to Python, which is far cheaper than arrays of
strings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import ne

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType


_COUNTS = (
    StructType()
    .add("substitutions", LongType())
    .add("deletions", LongType())
    .add("insertions", LongType())
)


def _trim(a: list, b: list) -> tuple[list, list]:
    """Drop the common head and tail; neither changes an optimal alignment."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    return a[i : len(a) - j], b[i : len(b) - j]


def _common(a: list, b: list) -> int:
    """Tokens in common, whatever their places: no alignment has more matches."""
    return (Counter(a) & Counter(b)).total()


def bit_distance(a: list, b: list) -> int:
    """Unit-cost edit distance, one big-integer step per token of ``b``.

    No distance is less than what the longer text has beyond the tokens in
    common. Where every token of the shorter one is in common and in order, or
    texts of one length differ in just so many places, that is the distance.
    """
    a, b = _trim(a, b)
    if not a or not b:
        return len(a) + len(b)
    least = max(len(a), len(b)) - _common(a, b)
    if len(a) == len(b):
        if sum(map(ne, a, b)) == least:
            return least
    elif least == abs(len(a) - len(b)):
        short, rest = (a, iter(b)) if len(a) < len(b) else (b, iter(a))
        if all(t in rest for t in short):
            return least
    where: dict = {}
    for i, tok in enumerate(a):
        where[tok] = where.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    up, down, dist = full, 0, len(a)
    for tok in b:
        eq = where.get(tok, 0)
        diag = ((((eq & up) + up) ^ up) | eq | down) & full
        right_up = (down | ~(diag | up)) & full
        right_down = up & diag
        if right_up & top:
            dist += 1
        elif right_down & top:
            dist -= 1
        right_up = ((right_up << 1) | 1) & full
        right_down = (right_down << 1) & full
        up = (right_down | ~(diag | right_up)) & full
        down = right_up & diag
    return dist


#: Cells of one step of ``batch_counts``: an antidiagonal of the bands of all its pairs.
STEP_CELLS = 1 << 16


def _groups(shapes: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    """Pairs (number, n, m, reach) in groups of like reach, whose bands fit into one step together; a wider band is alone."""
    ordered = sorted(shapes, key=lambda s: (s[3], s[1] + s[2]))
    group: list[tuple[int, int, int, int]] = []
    for shape in ordered:
        if group and ((shape[3] + 2) * (len(group) + 1) > STEP_CELLS or shape[3] > 8 + 1.5 * group[0][3]):
            yield group
            group = []
        group.append(shape)
    if group:
        yield group


def batch_counts(pairs: list[tuple[list, list]]) -> np.ndarray:
    """(substitutions, deletions, insertions) of a cheapest alignment of each pair.

    Among equally cheap alignments the one with fewest substitutions counts.
    A wavefront of antidiagonals runs through the alignment tables of many
    pairs at once, as an array of pairs by diagonals; the band around the main
    diagonal is as wide as the unit distance proves enough. Insertions outnumber
    deletions by ``m - n``; either with the substitutions make up at least the
    tokens that are not in common. So an alignment of ``dist`` edits has at
    least ``n + m - 2 * common - dist`` and at most ``dist - |m - n|``
    substitutions, always even or always odd, and takes no more steps off the
    diagonal than edits are left beside the tokens not in common. An antidiagonal
    needs the one before, whose diagonals have the other parity, and its own
    diagonals' last cells, which are overwritten in place.
    """
    out = np.zeros((len(pairs), 3), np.int64)
    trimmed, shapes = [], []
    for k, (ref, hyp) in enumerate(pairs):
        a, b = _trim(ref, hyp)
        trimmed.append((a, b))
        if not a or not b:
            out[k] = 0, len(a), len(b)
            continue
        n, m, dist = len(a), len(b), bit_distance(a, b)
        common = _common(a, b)
        most_subs = dist - abs(m - n)
        if most_subs - max(0, n + m - 2 * common - dist) < 2:
            out[k] = most_subs, max(0, n - m), max(0, m - n)
            continue
        above, below = min((dist + m - n) // 2, dist - (n - common)), min((dist + n - m) // 2, dist - (m - common))
        shapes.append((k, n, m, max(above, below)))
    for group in _groups(shapes):
        group.sort(key=lambda s: -(s[1] + s[2]))
        reach = max(s[3] for s in group)
        reach += reach % 2
        n_most, m_most = max(s[1] for s in group), max(s[2] for s in group)
        pad = reach + 2
        x = np.full((len(group), n_most + 2 * pad), -1, np.int32)  # backwards, as rows fall where columns rise
        y = np.full((len(group), m_most + n_most + 2 * pad), -2, np.int32)
        most = 0
        for p, (k, n, m, _) in enumerate(group):
            codes: dict = {}
            a, b = ([codes.setdefault(t, len(codes)) for t in side] for side in trimmed[k])
            x[p, pad + n_most - n : pad + n_most] = a[::-1]
            y[p, pad : pad + m] = b
            most = max(most, n + m + 1)
        small = most * (most + 1) < 1 << 29
        kind = np.int32 if small else np.int64
        gap, far = kind(most), kind((1 << 29) if small else (1 << 60))  # one edit outweighs any number of substitutions
        change = gap + kind(1)
        even, odd = np.full((len(group), reach + 1), far, kind), np.full((len(group), reach + 2), far, kind)
        even[:, reach // 2] = 0
        active = len(group)
        for d in range(1, group[0][1] + group[0][2] + 1):
            while group[active - 1][1] + group[active - 1][2] < d:
                active -= 1
            if d % 2:
                width, first = reach, 1 - reach
                now, low, high = odd[:active, 1:-1], even[:active, :-1], even[:active, 1:]
            else:
                width, first = reach + 1, -reach
                now, low, high = even[:active], odd[:active, :-1], odd[:active, 1:]
            if width:
                row, column = n_most - (d - first) // 2 + pad, (d + first) // 2 - 1 + pad
                changed = x[:active, row : row + width] != y[:active, column : column + width]
                kept = changed * change
                kept += now
                step = np.minimum(low, high)
                step += gap
                np.minimum(kept, step, out=now)
            for p in range(active - 1, -1, -1):
                k, n, m, _ = group[p]
                if n + m != d:
                    break
                edits, subs = divmod(int(now[p, (m - n - first) // 2]), int(gap))
                indels = edits - subs
                dels = (indels + n - m) // 2
                out[k] = subs, dels, indels - dels
    return out


def edit_counts(ref: list, hyp: list) -> tuple[int, int, int]:
    """``batch_counts`` of one pair."""
    return tuple(batch_counts([(ref, hyp)])[0].tolist())


@F.pandas_udf(LongType())
def _distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series(
        [None if r is None or h is None else bit_distance(r.split(), h.split()) for r, h in zip(ref, hyp)],
        dtype="Int64",
    )


@F.pandas_udf(_COUNTS)
def _counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    got = batch_counts([(r.split(), h.split()) for r, h in zip(ref, hyp)])
    return pd.DataFrame(got, columns=["substitutions", "deletions", "insertions"])


def counts(ref: Column, hyp: Column) -> Column:
    return _counts(ref, hyp)


def words(text: Column) -> Column:
    """Number of tokens of a single-blank separated text."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def token_distance(ref: Column, hyp: Column) -> Column:
    """Edit distance of two token texts as a BIGINT."""
    return _distance(ref, hyp)
