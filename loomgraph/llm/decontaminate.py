"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared in lower case with single blanks. An item
is cut into regions of ``REGION`` characters, one at every quarter of that length (a shorter
item is one region), so any excerpt of an item from REGION * 5 / 4 - 1 characters on holds a
region whole. A region of n characters occurs in a text if ``RATE`` * n
edits turn it into a piece of the text. Each edit spoils at most q of the n - q + 1
character q-grams, so an occurrence with e edits shares at least n - q + 1 - e * q of
them with the text, all on e + 1 neighbouring diagonals. Shared q-grams are counted in
overlapping diagonal bands; bands that reach the bound are verified by banded alignment.

Items are read in slices of about ``SLICE`` characters: what goes to every task is
bounded, and a larger benchmark takes more passes over the documents.

Edge cases: a null or empty text is clean; null, empty and shorter items than
q characters match nothing; equal items are reported each; a null id is a value
like another; an empty benchmark leaves everything clean; an empty table gives no
rows; other columns are kept by ``clean`` and ignored by ``leaks``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import arrays
from loomgraph.llm.passages import Index, find, spans, texts_of

#: Length of the grams, characters of a region, edits for each character of it.
Q, REGION, RATE = 8, 80, 0.1
#: About so many characters of the benchmark are held by a task.
SLICE = 400_000

LEAKS = "doc_id long, item_id long, edits long, spans array<struct<start:long,end:long>>"


def regions(codes: np.ndarray, size: int = REGION) -> list[np.ndarray]:
    """Overlapping pieces that cover an item; the last one is flush with its end."""
    if len(codes) <= size:
        return [codes]
    starts = [*range(0, len(codes) - size, size // 4), len(codes) - size]
    return [codes[s : s + size] for s in starts]


def budget(n: int, q: int = Q, rate: float = RATE) -> int:
    """Most edits for n characters such that the bound on shared grams is at least one."""
    return max(0, min(int(rate * n), (n - q) // q))


def build_index(items: list[tuple[int, str | None]]) -> tuple[Index, list[int | None]]:
    passages, owners = [], []
    for item, text in items:
        codes, _, _ = arrays.plain([text])
        if len(codes) >= Q:
            for piece in regions(codes):
                passages.append(piece)
                owners.append(item)
    budgets = np.array([budget(len(p)) for p in passages], np.int64)
    needed = np.array([len(p) - Q + 1 - e * Q for p, e in zip(passages, budgets, strict=True)], np.int64)
    return Index.build(passages, budgets, needed, Q), owners


def slices(benchmark: DataFrame) -> Iterator[tuple[Index, list[int | None]]]:
    """Indexes over parts of the benchmark, each of bounded size."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(chars / SLICE))
    for part in range(parts):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield build_index([(r["item_id"], r["text"]) for r in held])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item of which a region occurs in it.

    ``edits`` is the least of any region, ``spans`` are places in the text as it is.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index, owners in slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index, owners=owners) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for low, _, codes, offsets, own in texts_of(batch):
                    found = find(index, codes, offsets)
                    rows = defaultdict(list)
                    for r, p, start, end, edits in zip(*(x.tolist() for x in (found.row, found.passage, found.start, found.end, found.edits)), strict=True):
                        rows[r, owners[p]].append((int(own[start]), int(own[end - 1]) + 1, edits))
                    if rows:
                        yield pa.record_batch(
                            [
                                pa.array([ids[low + r] for r, _ in rows], pa.int64()),
                                pa.array([item for _, item in rows], pa.int64()),
                                pa.array([min(x[2] for x in v) for v in rows.values()], pa.int64()),
                                pa.array([spans([x[0] for x in v], [x[1] for x in v]) for v in rows.values()], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                            ],
                            names=["doc_id", "item_id", "edits", "spans"],
                        )

        part = texts.mapInArrow(run, LEAKS)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which nothing of the benchmark occurs, with all their columns."""
    for index, _ in slices(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for low, _, codes, offsets, _ in texts_of(batch):
                    keep[low + find(index, codes, offsets).row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
