"""Ranked lexical search by presence masks.

The texts are read once: each document becomes its length and the counts of the terms that
some item asks for, written as a compact table. Sums over that table give the corpus
statistics. The ranking then works on blocks of documents inside Spark tasks: every term
of a block has a bitmap of its documents; the bitmaps of an item's terms, turned over, are
one presence mask for each document. Documents are grouped by mask. A mask's score is at
most the sum of what each of its terms reaches anywhere in the block, so masks are
evaluated by descending bound and the item is finished with the block as soon as the next
bound is below the score of the item's last rank so far. Nothing is skipped that could
still enter the ranks: the floor is the score of a document that was scored in full.

A first pass over a bounded sample of documents supplies floors for the pass over all of
them, so tasks return few rows beyond the true ranks, and what is shuffled by item stays
near ``top`` rows an item and task.

What goes to every task is bounded: items are taken in slices of about ``SLICE``
characters (more slices are more passes), a floor and ``top`` rows for each of them.

Edge cases: a null or empty text, or one without terms, is in no statistic and no
ranking; an item without terms has no rows; repeated rows of documents are documents of
their own; a null doc_id comes after others of the same score; items of equal id and text
are one item, of equal id and other text ranked apart; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import arrays
from loomgraph.llm.tables import Scratch

#: Maximal runs of letters and digits; only A-Z are lower-cased, so bytes will do.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Characters of items that a task holds, documents of a block, and of the first pass.
SLICE, BLOCK, FIRST = 4_000_000, 8192, 50_000
#: Presences of terms in documents that are held unpacked.
CELLS = 1 << 22

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
RANKED = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode(errors="surrogatepass").lower())


@dataclass
class Items:
    """A slice of the items: for each its distinct terms, as numbers, and how often it has them."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @staticmethod
    def build(rows: list[tuple[int | None, str | None]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        out = Items([], vocabulary, [], [])
        for item, text in rows:
            if counts := Counter(terms_of(text)):
                out.ids.append(item)
                out.terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int64))
                out.repeats.append(np.array([*counts.values()], np.int64))
        return out


def slices(items: DataFrame) -> Iterator[Items]:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0).distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(chars / SLICE))
    for part in range(parts):
        held = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()  # about SLICE characters
        yield Items.build([(r["item_id"], r["text"]) for r in held])


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Length of each document that has terms, and its counts of the vocabulary's."""
    known = vocabulary.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            data, offsets = arrays.utf8(column)
            for low, high in arrays.slices(offsets):
                ids, sizes, ends, terms, counts = [], [], [0], [], []
                for row in range(low, high):
                    found = TERM.findall(data[offsets[row] : offsets[row + 1]].tobytes().lower())
                    if found:
                        tally = Counter(found)
                        asked = [(vocabulary[t], tally[t]) for t in tally.keys() & known]
                        terms += [t for t, _ in asked]
                        counts += [c for _, c in asked]
                        ids.append(row)
                        sizes.append(len(found))
                        ends.append(len(terms))
                yield pa.record_batch(
                    [
                        batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int32())),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


@dataclass
class Statistics:
    documents: int
    words: int
    weights: np.ndarray  # of each term of the vocabulary

    @staticmethod
    def of(held: DataFrame, many: int) -> Statistics:
        row = held.agg(F.count("*").alias("n"), F.sum("n").alias("words")).first()
        found = held.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # the vocabulary at most
        df = np.zeros(many, np.int64)
        df[found["term"].to_numpy()] = found["count"].to_numpy()
        weights = [math.floor(1000 * math.log((2 * row["n"] + 2) / (2 * d + 1))) for d in df.tolist()]
        return Statistics(row["n"], row["words"] or 0, np.array(weights, np.int64))


class Block:
    """Documents of a task: bitmaps of their terms, and what each term adds in each."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, stats: Statistics):
        self.ids, self.missing, self.many = ids, missing, len(ids)
        order = np.lexsort((row, term))
        row, count = row[order], count[order]
        self.terms, first = np.unique(term[order], return_index=True)
        place = np.repeat(np.arange(len(self.terms)), np.diff(np.append(first, len(row))))
        m = 75 + 25 * n * stats.documents // max(stats.words, 1)
        self.adds = 1_000_000_000 * count // (1000 * count + 12 * m[row])
        self.keys = place * self.many + row
        self.most = np.maximum.reduceat(self.adds, first) if len(first) else np.zeros(0, np.int64)
        width = -(-self.many // 8)
        cell = place * width + (row >> 3)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        self.bits = np.zeros((len(self.terms), width), np.uint8)
        if len(starts):
            self.bits.ravel()[cell[starts]] = np.add.reduceat(128 >> (row & 7), starts)

    def masks(self, places: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(presence of the terms in each distinct mask, mask of each document from ``low`` to ``high``)."""
        present = np.unpackbits(self.bits[places, low // 8 : -(-high // 8)], axis=1, count=high - low)
        packed = np.packbits(present, axis=0, bitorder="little")
        packed = np.concatenate((packed, np.zeros((-len(packed) % 8, high - low), np.uint8)))
        words = np.ascontiguousarray(packed.T).view(np.uint64)
        _, at, mask = np.unique(words[:, 0], return_index=True, return_inverse=True)
        for k in range(1, words.shape[1]):
            _, more = np.unique(words[:, k], return_inverse=True)
            _, at, mask = np.unique(mask * (more.max() + 1) + more, return_index=True, return_inverse=True)
        return present[:, at].T, mask

    def scores(self, docs: np.ndarray, places: np.ndarray, gains: np.ndarray) -> np.ndarray:
        keys = places[None, :] * self.many + docs[:, None]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (np.where(self.keys[at] == keys, self.adds[at], 0) * gains[None, :]).sum(axis=1)


class Ranks:
    """The best documents of each item so far, in order."""

    def __init__(self, floors: np.ndarray, top: int):
        self.floors, self.top = floors.copy(), top
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        self.best = [none for _ in floors]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        keep = scores >= self.floors[item]
        if keep.any():
            scores, ids, missing = (np.concatenate((a, b[keep])) for a, b in zip(self.best[item], (scores, ids, missing), strict=True))
            order = np.lexsort((ids, missing, -scores))[: self.top]
            self.best[item] = scores[order], ids[order], missing[order]
            if len(order) == self.top:
                self.floors[item] = max(self.floors[item], scores[order[-1]])

    def rank(self, block: Block, items: Items, stats: Statistics) -> None:
        if not len(block.terms):
            return
        for item, (terms, repeats) in enumerate(zip(items.terms, items.repeats, strict=True)):
            places = np.searchsorted(block.terms, terms)
            there = block.terms[np.minimum(places, len(block.terms) - 1)] == terms
            places, gains = places[there], stats.weights[terms[there]] * repeats[there]
            if gains @ block.most[places] < self.floors[item] or not len(places):
                continue
            # An item of very many terms takes fewer documents at a time.
            width = max(64, CELLS // len(places) // 8 * 8)
            for low in range(0, block.many, width):
                self.rank_masks(item, block, places, gains, low, min(low + width, block.many))

    def rank_masks(self, item: int, block: Block, places: np.ndarray, gains: np.ndarray, low: int, high: int) -> None:
        present, mask = block.masks(places, low, high)
        bounds = present.astype(np.int64) @ (gains * block.most[places])
        by_bound = np.argsort(-bounds, kind="stable")
        groups = np.argsort(mask, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(mask, minlength=len(bounds)))))
        upto = np.cumsum(np.diff(first)[by_bound])  # documents in the masks so far
        done, want = 0, self.top
        while done < len(by_bound) and bounds[by_bound[done]] >= self.floors[item]:
            stop = 1 + int(np.searchsorted(upto, (upto[done - 1] if done else 0) + want))
            some = by_bound[done:stop]
            some = some[bounds[some] >= self.floors[item]]
            docs = low + np.concatenate([groups[first[k] : first[k + 1]] for k in some])
            for at in range(0, len(docs), CELLS // (8 * len(places)) + 1):
                part = docs[at : at + CELLS // (8 * len(places)) + 1]
                self.add(item, block.scores(part, places, gains), block.ids[part], block.missing[part])
            done, want = stop, want * 2


def blocks(batches: Iterator[pa.RecordBatch], stats: Statistics) -> Iterator[Block]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            ids, terms, counts = part.column("doc_id"), part.column("terms"), part.column("counts")
            ends = terms.offsets.to_numpy().astype(np.int64)
            yield Block(
                ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("n").to_numpy(),
                np.repeat(np.arange(part.num_rows), np.diff(ends)), terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64), stats,
            )


def ranked(held: DataFrame, items: Items, stats: Statistics, floors: np.ndarray, top: int) -> DataFrame:
    """The documents of each task that may be among an item's best, in its place ``item`` of the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(floors, top)
        for block in blocks(batches, stats):
            ranks.rank(block, items, stats)
        for low in range(0, len(ranks.best), 1000):
            part = ranks.best[low : low + 1000]
            number = np.repeat(np.arange(low, low + len(part)), [len(b[0]) for b in part])
            scores, ids, missing = (np.concatenate(x) for x in zip(*part, strict=True))
            yield pa.record_batch([pa.array(number.astype(np.int32)), pa.array(ids, mask=missing), pa.array(scores)], names=["item", "doc_id", "score"])

    every = held.mapInArrow(run, RANKED)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 20, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score above 0."""
    spark, out = docs.sparkSession, None
    for part in slices(items):
        scratch = Scratch(spark, "search")
        held = scratch.put("postings", postings(docs, part.vocabulary))
        stats = Statistics.of(held, len(part.vocabulary))
        floors = np.ones(len(part.ids), np.int64)
        if stats.documents > 2 * first:
            share = F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 20)) < int(first / stats.documents * (1 << 20))
            sample = ranked(held.where(share), part, stats, floors, top)
            for r in sample.where(F.col("rank") == top).select("item", "score").collect():  # a row for each item of the slice
                floors[r["item"]] = r["score"]
        best = ranked(held, part, stats, floors, top)
        names = spark.createDataFrame([*enumerate(part.ids)], "item int, item_id long")
        found = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # about SLICE characters of items
        out = found if out is None else out.union(found)
    return out
