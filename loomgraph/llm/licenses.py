"""License scans by winnowed fingerprints and banded alignment.

Each license has template texts, cut into sentences. Of each sentence, winnowing
keeps the least hash of every ``WINDOW`` neighbouring character grams as a
fingerprint; so does the scan with every text, and a shared run of ``GRAM`` + ``WINDOW`` - 1
characters always shares one. The fingerprints of the templates form an inverted
index; hits on neighbouring diagonals make candidates, and banded alignment of the
sentence with the text decides. The result is the matched share of a template's
characters and the matched spans.

Texts and templates are compared in lower case with single blanks. The templates are
given in this module or by the caller and are small; ``scan`` checks their size.

Edge cases: null and empty texts match nothing; a null doc_id is a value like
another; equal rows give equal results; an empty table or no templates give no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import arrays, license_notices
from loomgraph.llm.passages import Index, find, spans, texts_of

GRAM, WINDOW = 8, 5
#: Edits for each character of a sentence, and the least matched share that is reported.
RATE, COVERAGE = 0.12, 0.5
#: Most characters of all templates: they go to every task.
TEMPLATE_CHARS = 2_000_000

# Wording of public licenses and license notices, by SPDX name where there is one.
# Opening paragraphs count by themselves, beside the whole texts.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction. "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]
TEMPLATES = list(dict.fromkeys([*TEMPLATES, *license_notices.statements(), *license_notices.notices(), *license_notices.texts()]))

#: Start and end in a text, edits, sentence.
Place = tuple[int, int, int, int]

MATCHES = "doc_id long, license string, coverage double, edits long, spans array<struct<start:long,end:long>>"


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of grams that are the least of some window (fewer grams are one window)."""
    n = len(grams)
    if n <= window:
        return np.flatnonzero(grams == grams.min()) if n else np.zeros(0, np.int64)
    least = grams[: n - window + 1].copy()
    for k in range(1, window):
        np.minimum(least, grams[k : n - window + 1 + k], out=least)
    chosen = np.zeros(n, bool)
    for k in range(window):
        chosen[k : n - window + 1 + k] |= grams[k : n - window + 1 + k] == least
    return np.flatnonzero(chosen)


def build_index(templates: list[tuple[str, str]]) -> tuple[Index, list[int]]:
    """The index of all sentences, and the template that each belongs to."""
    passages, owners = [], []
    for k, (_, text) in enumerate(templates):
        for sentence in re.split(r"(?<! v\.)(?<=\.)\s+", text):
            codes, _, _ = arrays.plain([sentence])
            if len(codes) >= GRAM:
                passages.append(codes)
                owners.append(k)
    budgets = np.array([int(RATE * len(p)) for p in passages], np.int64)
    # A fingerprint in a hundred characters, one at least: alignment decides.
    needed = np.array([1 + len(p) // 100 for p in passages], np.int64)
    return Index.build(passages, budgets, needed, GRAM, winnow), owners


class _Taken:
    """Places of a text that licenses hold, found by cells of 64 characters."""

    def __init__(self) -> None:
        self.cells: dict[int, list[tuple[int, int, str, int]]] = defaultdict(list)

    def add(self, start: int, end: int, name: str, value: int) -> None:
        for cell in range(start >> 6, ((end - 1) >> 6) + 1):
            self.cells[cell].append((start, end, name, value))

    def held(self, start: int, end: int, name: str, value: int) -> bool:
        """Whether another license has more than ``value`` on most of the place, or of the shorter one."""
        for cell in range(start >> 6, ((end - 1) >> 6) + 1):
            for a, b, other, have in self.cells.get(cell, ()):
                if other != name and have > value and 2 * (min(b, end) - max(a, start)) > min(b - a, end - start):
                    return True
        return False


def _contest(places: list[Place], name: Callable[[int], str], length: Callable[[int], int], owners: list[int], size: dict[int, int]) -> list[Place]:
    """The places that each license wins from the others.

    On each place the sentence with most characters less twice its edits wins. Where
    sentences of several licenses are equal, the place goes to the license of which more
    of the text stands around it: a run of sentences in the template's order counts its
    matched characters less the missing ones.
    """
    taken, won = _Taken(), defaultdict(list)
    for place in sorted(places, key=lambda x: (2 * x[2] - length(x[3]), x)):
        start, end, edits, p = place
        if not taken.held(start, end, name(p), length(p) - 2 * edits):
            taken.add(start, end, name(p), length(p) - 2 * edits)
            won[owners[p]].append(place)

    def entry(k: int, run: list[Place]) -> tuple[int, str, int, list[Place]]:
        return size[k] - sum(2 * (length(p) - e) for _, _, e, p in run), name(run[0][3]), k, run

    heap = []
    for k, own in won.items():
        runs: list[list[Place]] = []
        for place in sorted(own):
            if runs and runs[-1][-1][3] < place[3]:
                runs[-1].append(place)
            else:
                runs.append([place])
        heap += [entry(k, run) for run in runs]
    heapq.heapify(heap)
    taken, out = _Taken(), []
    while heap:
        _, own_name, k, run = heapq.heappop(heap)
        rest = [x for x in run if not taken.held(x[0], x[1], own_name, 0)]
        if len(rest) == len(run):
            for x in run:
                taken.add(x[0], x[1], own_name, 1)
            out += run
        elif rest:
            heapq.heappush(heap, entry(k, rest))
    return out


def _stated(found: list[Place], templates: list[tuple[str, str]], passages: list[np.ndarray], owners: list[int], size: dict[int, int], least: float) -> dict[str, tuple[float, int, list[Place]]]:
    """(coverage, edits, places) of each license that one text states.

    Templates whose won places do not reach ``least`` leave, the least covered first,
    and their places are open to the others again.
    """

    def name(p: int) -> str:
        return templates[owners[p]][0]

    def length(p: int) -> int:
        return len(passages[p])

    # Neighbouring bands find a place more than once: the best alignment stays.
    places, once = [], defaultdict(_Taken)
    for place in sorted(set(found), key=lambda x: (x[2], x)):
        if not once[place[3]].held(place[0], place[1], "", 0):
            once[place[3]].add(place[0], place[1], "place", 1)
            places.append(place)

    def covered(own: list[Place]) -> dict[int, tuple[float, int, int]]:
        edits: dict[int, dict[int, int]] = defaultdict(dict)
        for _, _, e, p in own:
            edits[owners[p]][p] = min(e, edits[owners[p]].get(p, e))
        return {k: (sum(length(p) - e for p, e in v.items()) / size[k], -sum(v.values()), sum(map(length, v))) for k, v in edits.items()}

    alive = {k for k, v in covered(places).items() if v[0] >= least}
    while alive:
        won = _contest([x for x in places if owners[x[3]] in alive], name, length, owners, size)
        shares = covered(won)
        short = [k for k in alive if k in shares and shares[k][0] < least]
        alive = {k for k in alive if k in shares}
        if not short:
            break
        alive.discard(min(short, key=lambda k: (shares[k], -k)))
    out: dict[str, tuple[float, int, list[Place]]] = {}
    for k in sorted(alive, key=lambda k: (tuple(-x for x in shares[k]), k)):
        out.setdefault(templates[k][0], (shares[k][0], -shares[k][1], [x for x in won if owners[x[3]] == k]))
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = COVERAGE) -> DataFrame:
    """A row for each document and license that it states, as MATCHES.

    Where the wordings of several licenses fit the same characters, the best has them,
    place by place: a license keeps what it states elsewhere. ``coverage`` is the share
    of the license's best template that its own places match; ``spans`` are the places
    of its sentences in the text as it is.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t) for _, t in templates) > TEMPLATE_CHARS:
        raise ValueError("too many templates for one scan")
    index, owners = build_index(templates)
    size = defaultdict(int)
    for k, p in zip(owners, index.passages, strict=True):
        size[k] += len(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, _, codes, offsets, own in texts_of(batch):
                found = find(index, codes, offsets, winnow)
                places: dict[int, list[Place]] = defaultdict(list)
                for r, p, start, end, edits in zip(*(x.tolist() for x in (found.row, found.passage, found.start, found.end, found.edits)), strict=True):
                    places[r].append((start, end, edits, p))
                rows: dict[tuple[int, str], tuple] = {}
                for r, own_places in places.items():
                    for name, (share, edits, held) in _stated(own_places, templates, index.passages, owners, size, least).items():
                        rows[r, name] = (round(share, 6), edits, spans([int(own[x[0]]) for x in held], [int(own[x[1] - 1]) + 1 for x in held]))
                if rows:
                    yield pa.record_batch(
                        [
                            pa.array([ids[low + r] for r, _ in rows], pa.int64()),
                            pa.array([name for _, name in rows], pa.string()),
                            pa.array([v[0] for v in rows.values()], pa.float64()),
                            pa.array([v[1] for v in rows.values()], pa.int64()),
                            pa.array([v[2] for v in rows.values()], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        ],
                        names=["doc_id", "license", "coverage", "edits", "spans"],
                    )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)
