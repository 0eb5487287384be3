"""Alignment of many pairs of sequences at a time, in numpy arrays over a batch of pairs.

An alignment's score, identical columns and columns travel in one 64-bit number: score * 2**40 + identical * 2**20 - columns. So
the greater number is the higher score, then more identical columns, then fewer columns, and sums are the sums of all three.
Sequences may have up to 2**19 letters.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Scores of a column: equal, unequal, first column of a gap, further column of a gap.
MATCH, MISMATCH, OPEN, EXTEND = 1, -1, -2, -1
SCORE, SAME = 1 << 40, 1 << 20
LONGEST = 1 << 19
#: Numbers in one array of a batch.
CELLS = 1 << 20


def codes(texts: list[str], pad: int):
    """Letters as a matrix of code points, padded on the right."""
    import numpy as np

    out = np.full((len(texts), max(map(len, texts), default=0)), pad, dtype=np.int32)
    for k, s in enumerate(texts):
        out[k, : len(s)] = np.frombuffer(s.encode("utf-32-le"), dtype=np.int32)
    return out


def unpack(v):
    """(score, identical columns, columns)."""
    score = (v + SCORE // 2) >> 40
    rest = v - score * SCORE
    same = (rest + SAME // 2) >> 20
    return score, same, same * SAME - rest


def ungapped(a, b, diagonal):
    """The best run of columns on each pair's diagonal (places in b minus places in a), packed; a and b as of codes()."""
    import numpy as np

    i = np.arange(a.shape[1])[None, :]
    j = i + diagonal[:, None]
    inside = (j >= 0) & (j < b.shape[1])
    other = np.take_along_axis(b, np.clip(j, 0, max(b.shape[1] - 1, 0)), 1)
    step = np.where(a == other, MATCH * SCORE + SAME - 1, MISMATCH * SCORE - 1)
    # beyond either sequence nothing is a column
    ends = ~inside | (a < 0) | (other < 0)
    sums = np.cumsum(np.where(ends, 0, step), axis=1)
    before = np.minimum.accumulate(np.concatenate([np.zeros((len(a), 1), dtype=np.int64), sums[:, :-1]], axis=1), axis=1)
    return np.maximum((sums - before).max(axis=1, initial=0), 0)


def gapped(a, b):
    """The best local alignment of each pair with affine gaps (Smith & Waterman, 1981; Gotoh, 1982), packed.

    One step for a letter of all a's: gaps along b come from a running maximum, as each starts at a cell that isn't in one.
    """
    import numpy as np

    n, width = b.shape
    first, more = OPEN * SCORE - 1, EXTEND * SCORE - 1
    slope = -more * np.arange(width + 1, dtype=np.int64)[None, :]
    row = np.zeros((n, width + 1), dtype=np.int64)
    down = np.full((n, width + 1), -(1 << 61), dtype=np.int64)
    best = np.zeros(n, dtype=np.int64)
    for k in range(a.shape[1]):
        letter = a[:, k : k + 1]
        down = np.maximum(row + first, down + more)
        new = np.maximum(down, 0)
        step = np.where(b == letter, MATCH * SCORE + SAME - 1, MISMATCH * SCORE - 1)
        np.maximum(new[:, 1:], row[:, :-1] + step, out=new[:, 1:])
        run = np.maximum.accumulate(new + slope, axis=1)[:, :-1] - slope[:, 1:] - more + first
        new[:, 1:] = np.maximum(new[:, 1:], run)
        row = np.where(letter < 0, row, new)
        best = np.maximum(best, row.max(axis=1))
    return best


def chunks(rows: list[tuple]) -> Iterator[list[tuple]]:
    """rows (k, a, b, ...), pairs of like length together, as many at a time as CELLS holds."""
    rows, at = sorted(rows, key=lambda r: (len(r[2]), len(r[1]))), 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and (end + 1 - at) * (max(len(rows[end][2]), len(rows[end][1])) + 1) <= CELLS:
            end += 1
        yield rows[at:end]
        at = end
