"""Text of an Arrow batch as numpy arrays: word hashes, character grams, alignment.

Everything here works on a batch or a slice of a batch inside a Spark task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most bytes or characters that are held as wide numbers at a time.
SLICE = 1 << 18

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """The step-th random number of each seed."""
    return mix(seed + _GOLDEN * np.atleast_1d(np.asarray(step, dtype=np.uint64)))


def uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from random bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) / 9007199254740992.0


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes each, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end
        row = end


@functools.lru_cache(maxsize=1)
def _space_table() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return out


@functools.lru_cache(maxsize=4)
def _powers(size: int) -> np.ndarray:
    out = np.full(size, _WORD_BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each row and the end).

    A word is a run of bytes other than ASCII white space; it ends with its row.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_space_table()[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(np.cumsum(inside)[starts] - 1, inside.sum()))
    hashes = np.zeros(len(starts), np.uint64)
    row = 0
    while row < len(starts):
        stop = max(row + 1, int(np.searchsorted(starts, starts[row] + SLICE)))
        at, n = starts[row:stop], lengths[row:stop]
        run = np.concatenate(([0], np.cumsum(n)[:-1]))
        within = np.arange(n.sum()) - np.repeat(run, n)
        table = _powers(1 << max(10, int(n.max()).bit_length()))
        terms = (data[np.repeat(at, n) + within].astype(np.uint64) + np.uint64(1)) * table[within]
        hashes[row:stop] = mix(np.add.reduceat(terms, run))
        row = stop
    return hashes, np.searchsorted(starts, offsets)


def word_shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, distinct words) of every run of ``size`` words.

    A row with fewer words has one shingle of all its words, one without words none.
    """
    counts = np.diff(bounds)
    width = np.minimum(counts, size)
    shingles = np.where(counts > 0, counts - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), shingles)
    run = np.concatenate(([0], np.cumsum(shingles)))
    start = np.arange(run[-1]) - run[rows] + bounds[rows]
    out = np.zeros(len(start), np.uint64)
    distinct = np.zeros(len(start), np.int64)
    have = width[rows]
    parts: list[np.ndarray] = []
    for k in range(size):
        live = have > k
        part = np.zeros(len(start), np.uint64)
        part[live] = hashes[start[live] + k]
        out = out * np.uint64(0x5851F42D4C957F2D) + part
        new = live.copy()
        for seen in parts:
            new &= part != seen
        distinct += new
        parts.append(part)
    return rows, mix(out), np.maximum(distinct, 1)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    data = np.frombuffer(text.encode(), np.uint8)
    hashes, bounds = words(data, np.array([0, len(data)]))
    return np.unique(word_shingles(hashes, bounds, size)[1])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


@functools.lru_cache(maxsize=1)
def _lower_table() -> np.ndarray:
    """Lower case of every code point that has a single one; white space is a blank."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
        if chr(c).isspace():
            out[c] = 32
    return out


def plain(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets, place in the own text) of texts in comparable form.

    Lower case, each run of white space one blank, none at either end.
    """
    raw = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    ends = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    codes = _lower_table()[np.concatenate(raw)] if ends[-1] else np.zeros(0, np.uint32)
    blank = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    heads = ends[:-1][ends[:-1] < len(codes)]
    keep[heads] = ~blank[heads]
    where, offsets = np.flatnonzero(keep), np.concatenate(([0], np.cumsum(keep)))[ends]
    lasts = where[offsets[1:][np.diff(offsets) > 0] - 1]
    keep[lasts[blank[lasts]]] = False
    where = np.flatnonzero(keep)
    offsets = np.concatenate(([0], np.cumsum(keep)))[ends]
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    return codes[keep], offsets, where - ends[rows]


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the ``q`` code points from each place on (the last q-1 places have none)."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, have, size, done = 0x5851F42D4C957F2D, codes.astype(np.uint64) + np.uint64(1), 1, 0
    out = np.zeros(n, np.uint64)
    rest = q
    while rest:
        if rest & 1:
            out = out * np.uint64(pow(base, size, 1 << 64)) + have[done : done + n]
            done += size
        rest >>= 1
        if rest:
            have = have[:-size] * np.uint64(pow(base, size, 1 << 64)) + have[size:]
            size *= 2
    return mix(out)


def edit_alignments(
    text: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    patterns: np.ndarray,
    sizes: np.ndarray,
    first: np.ndarray,
    width: int,
    most: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best banded alignment of many patterns, each with a region of ``text``.

    Pattern i (row i of ``patterns``, ``sizes[i]`` long) may start on any of
    ``width`` diagonals from text place ``first[i]`` on and must stay on them;
    text outside ``[low[i], high[i])`` matches nothing. Returns the edits, and the
    start and end of the matched text. Of patterns that need more than ``most[i]`` edits
    only that is known: they are given up and have very many.
    """
    many = len(sizes)
    big = np.int64(1) << 32
    column = np.arange(width, dtype=np.int64)
    span = np.broadcast_to(column, (many, width)).copy()  # start diagonal in the low bits
    cost = span.copy()
    best = np.full(many, np.iinfo(np.int64).max)
    end = np.zeros(many, np.int64)
    padded = np.append(text, np.uint32(0xFFFFFFFF))
    live = np.arange(many)
    for i in range(int(sizes.max()) if many else 0):
        place = first[live, None] + column[None, :] + i
        outside = (place < low[live, None]) | (place >= high[live, None])
        char = padded[np.where(outside, len(text), place)]
        change = cost + big * (char != patterns[live, i : i + 1])
        skip = np.full_like(cost, np.iinfo(np.int64).max // 2)
        skip[:, :-1] = cost[:, 1:] + big  # a pattern character without text
        cost = np.minimum(change, skip)
        cost = np.minimum.accumulate(cost - big * column, axis=1) + big * column  # text without a pattern character
        ready = np.flatnonzero(sizes[live] == i + 1)
        if len(ready):
            at = cost[ready].argmin(axis=1)
            best[live[ready]] = cost[ready, at]
            end[live[ready]] = first[live[ready]] + at + i + 1
        if i % 8 == 7:
            open_ = sizes[live] > i + 1
            if most is not None:
                open_ &= cost.min(axis=1) >> np.int64(32) <= most[live]
            if 4 * open_.sum() < 3 * len(live):
                live, cost = live[open_], cost[open_]
                if not len(live):
                    break
    start = first + (best & (big - 1))
    return best >> np.int64(32), np.maximum(start, low), np.minimum(end, high)
