"""Known passages inside texts: an inverted index of character grams, candidates
on diagonals, and banded alignment. Shared by decontamination and license scans.

A passage that begins at place p of a text and of which the place j matches text
place i lies on the diagonal i - j; with at most e edits, an occurrence keeps to
e + 1 neighbouring diagonals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from loomgraph.llm import arrays

_BITS = 20
#: Most candidates that are aligned at a time.
_ALIGNED = 2000
#: Length of the grams that are counted in passages from so many characters on.
_SHORT, _COUNTED = 4, 100
#: Bits of such a gram that tell whether two are equal.
_CELLS = 16


@dataclass
class Index:
    """Grams of passages: for each hash (sorted) the passages and places that have it."""

    passages: list[np.ndarray]
    budgets: np.ndarray  # most edits
    needed: np.ndarray  # least shared grams in a band
    q: int
    keys: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    sizes: np.ndarray  # of the passages
    short: dict[int, np.ndarray] = field(default_factory=dict)  # cells of the short grams of passages that were counted

    @staticmethod
    def build(
        passages: list[np.ndarray], budgets: np.ndarray, needed: np.ndarray, q: int, pick: Callable[[np.ndarray], np.ndarray] | None = None
    ) -> Index:
        """``pick`` selects the places whose grams are indexed; all without it."""
        hashes, who, where = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, codes in enumerate(passages):
            grams = arrays.grams(codes, q)
            at = np.arange(len(grams)) if pick is None else pick(grams)
            hashes.append(grams[at])
            who.append(np.full(len(at), k))
            where.append(at)
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return Index(
            passages, budgets, needed, q, keys, np.append(first, len(every)),
            np.concatenate(who)[order], np.concatenate(where)[order], bitmap, np.array([len(p) for p in passages], np.int64),
        )

    def hits(self, grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text place, passage, passage place) of equal grams; ``at`` are places of ``grams`` to look up."""
        at = at[self.bitmap[(grams[at] >> np.uint64(64 - _BITS)).astype(np.int64)]]
        if not len(self.keys) or not len(at):
            return (np.zeros(0, np.int64),) * 3
        k = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[k] == grams[at]
        at, k = at[same], k[same]
        many = self.first[k + 1] - self.first[k]
        run = np.concatenate(([0], np.cumsum(many)))
        entry = np.arange(run[-1]) - np.repeat(run[:-1], many) + np.repeat(self.first[k], many)
        return np.repeat(at, many), self.passage[entry], self.place[entry]


@dataclass
class Matches:
    row: np.ndarray
    passage: np.ndarray
    start: np.ndarray
    end: np.ndarray
    edits: np.ndarray


def _cells(codes: np.ndarray) -> np.ndarray:
    return (arrays.grams(codes, _SHORT) >> np.uint64(64 - _CELLS)).astype(np.int32)


def _plausible(index: Index, codes: np.ndarray, passage: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether long passages share as many short grams with their band's text as the
    q-gram lemma asks for; short ones are aligned faster than counted.

    Grams are known by some bits of their hash: at worst too many seem shared.
    """
    keep = np.ones(len(passage), bool)
    long = np.flatnonzero(index.sizes[passage] >= _COUNTED)
    if len(long):
        text, near = _cells(codes), np.zeros(1 << _CELLS, bool)
        begin = np.maximum(first, 0)
        end = np.maximum(first + index.sizes[passage] + 2 * (index.budgets[passage] + 1), 0)
        for k in np.unique(passage[long]).tolist():
            if k not in index.short:
                index.short[k] = _cells(index.passages[k])
            own, needed = index.short[k], index.sizes[k] - _SHORT + 1 - _SHORT * index.budgets[k]
            for i in long[passage[long] == k].tolist():
                here = text[begin[i] : end[i]]
                near[here] = True
                keep[i] = np.count_nonzero(near[own]) >= needed
                near[here] = False
    return keep


def find(index: Index, codes: np.ndarray, offsets: np.ndarray, choose: Callable[[np.ndarray], np.ndarray] | None = None) -> Matches:
    """Occurrences of passages within their edit budgets in texts laid end to end.

    ``choose`` selects the places of a text whose grams are looked up; all without it.
    """
    many, q = len(offsets) - 1, index.q
    grams = arrays.grams(codes, q)
    rows = np.repeat(np.arange(many), np.diff(offsets))
    inside = rows[: len(grams)] == rows[q - 1 :] if len(grams) else np.zeros(0, bool)
    grams = np.where(inside, grams, np.uint64(0xFFFFFFFFFFFFFFFF))
    at = np.flatnonzero(inside) if choose is None else choose(grams)
    at = at[inside[at]]
    place, passage, where = index.hits(grams, at)
    # Bands of two budget widths that overlap by one: any occurrence lies in one of them whole.
    width = index.budgets[passage] + 1
    lead = 1 + int(index.sizes.max(initial=0))
    band = (place - where + lead) // width
    spread = len(codes) + 2 * lead + 2
    key = ((passage * many + rows[place]) * spread + band) if len(place) else np.zeros(0, np.int64)
    key, shared = np.unique(np.concatenate((key, key[band > 0] - 1)), return_counts=True)
    passage, row, band = key // spread // many, key // spread % many, key % spread
    keep = shared >= index.needed[passage] if len(key) else np.zeros(0, bool)
    passage, row, band = passage[keep], row[keep], band[keep]
    # Alike sizes are aligned together: the longest passage sets the steps and the width of all.
    order = np.argsort(index.sizes[passage], kind="stable")
    passage, row, band = passage[order], row[order], band[order]
    if choose is not None:
        keep = _plausible(index, codes, passage, band * (index.budgets[passage] + 1) - lead)
        passage, row, band = passage[keep], row[keep], band[keep]
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, len(passage), _ALIGNED):
        p, r, b = passage[low : low + _ALIGNED], row[low : low + _ALIGNED], band[low : low + _ALIGNED]
        sizes = index.sizes[p]
        patterns = np.zeros((len(p), sizes.max()), np.uint32)
        for i, k in enumerate(p):
            patterns[i, : sizes[i]] = index.passages[k]
        first = b * (index.budgets[p] + 1) - lead
        width = int(2 * (index.budgets[p].max() + 1))
        edits, start, end = arrays.edit_alignments(codes, offsets[r], offsets[r + 1], patterns, sizes, first, width, index.budgets[p])
        good = edits <= index.budgets[p]
        found.append((r[good], p[good], start[good], end[good], edits[good]))
    if not found:
        return Matches(*(np.zeros(0, np.int64),) * 5)
    return Matches(*(np.concatenate(x) for x in zip(*found, strict=True)))


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, code points, offsets, own places) of a batch's texts in comparable form, in slices."""
    column = batch.column("text")
    _, offsets = arrays.utf8(column)
    for low, high in arrays.slices(offsets):
        yield low, high - low, *arrays.plain(column.slice(low, high - low).to_pylist())


def spans(starts: list[int], ends: list[int]) -> list[dict[str, int]]:
    """Union of intervals."""
    out: list[dict[str, int]] = []
    for start, end in sorted(zip(starts, ends, strict=True)):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out
