"""Near-duplicates of whole documents by ProbMinHash.

A document is the set of its five-word shingles, each with a weight: how many
of its words differ from each other, so that runs of one word count less. The
signature is ProbMinHash: every shingle is a Poisson process whose rate is its
weight; an arrival falls on a random slot, and the slot keeps the shingle with
the earliest arrival. A shingle stops as soon as its arrivals come later than the
latest slot. The share of equal slots estimates the probability Jaccard
similarity. Equal bands of slots make two documents candidates, and the exact
Jaccard similarity of their shingle sets decides.

Equal word sequences are one document from the start; their copies never meet.

Edge cases: case and white space do not count; a text of fewer than five words
is one shingle; null and empty texts are copies of each other and near nothing
else; rows with the same doc_id need the same text (else the class holds both);
rows without a doc_id are left alone (class null); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import arrays
from loomgraph.llm.linking import link_buckets, marked, marks
from loomgraph.llm.tables import Scratch

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Slots in a band and bands: a pair at the threshold shares a band with probability 0.9999.
BAND_SLOTS, BANDS = 5, 25

SIGNATURES = "doc_id long, d1 long, d2 long, bands array<long>"


def prob_minhash(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, many: int, slots: int) -> np.ndarray:
    """(many, slots) signatures of weighted sets; elements of a row may repeat.

    Arrivals come in blocks that grow, since most elements stop after the first.
    """
    early = np.full(many * slots, np.inf)
    owner = np.zeros(many * slots, np.uint64)
    at, rate = np.zeros(len(rows)), weights.astype(np.float64)
    step, block = 1, 1
    while len(rows):
        steps = np.arange(step, step + block, dtype=np.uint64)[None, :]
        gaps = -np.log(arrays.uniform(arrays.stream(hashes[:, None], steps))) / rate[:, None]
        times = at[:, None] + np.cumsum(gaps, axis=1)
        slot = (arrays.stream(~hashes[:, None], steps) % np.uint64(slots)).astype(np.int64) + rows[:, None] * slots
        flat, when = slot.ravel(), times.ravel()
        np.minimum.at(early, flat, when)
        won = when == early[flat]
        owner[flat[won]] = np.broadcast_to(hashes[:, None], slot.shape).ravel()[won]
        latest = early.reshape(many, slots).max(axis=1)
        live = times[:, -1] < latest[rows]
        rows, hashes, rate, at = rows[live], hashes[live], rate[live], times[live, -1]
        step += block
        block = min(64, block * 2)
    return owner.reshape(many, slots)


def _signatures(batches: Iterator[pa.RecordBatch], size: int, band_slots: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = arrays.utf8(batch.column(1))
        for low, high in arrays.slices(offsets):
            part = offsets[low : high + 1]
            hashes, bounds = arrays.words(data[part[0] : part[-1]], part - part[0])
            many = high - low
            rows, shingles, weights = arrays.word_shingles(hashes, bounds, size)
            owners = prob_minhash(rows, shingles, weights, many, band_slots * bands)
            # a document's own words in order: a number for equal texts
            place = arrays.mix(np.arange(len(hashes), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64))
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(arrays.mix(hashes ^ (place + np.uint64(k)))))) for k in (1, 2)]
            digests = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (many, bands)).copy()
            for k in range(band_slots):
                keys = arrays.mix(keys * np.uint64(0x9E3779B97F4A7C15) + owners.reshape(many, bands, band_slots)[:, :, k])
            full = np.diff(bounds) > 0
            lists = pa.ListArray.from_arrays(
                np.concatenate(([0], np.cumsum(np.where(full, bands, 0)))).astype(np.int32), pa.array(keys[full].ravel().view(np.int64))
            )
            yield pa.record_batch([batch.column(0).slice(low, many), pa.array(digests[0]), pa.array(digests[1]), lists], names=["doc_id", "d1", "d2", "bands"])


def _shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    rows, hashes, _ = arrays.word_shingles(*arrays.words(*arrays.utf8(texts)), size)
    return rows, hashes


def _alike(batches: Iterator[pa.RecordBatch], size: int, least: float) -> Iterator[pa.RecordBatch]:
    known = functools.lru_cache(maxsize=64)(lambda text: arrays.shingle_set(text, size))
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            texts = zip(part.column("ta").to_pylist(), part.column("tb").to_pylist(), strict=True)
            keep = [arrays.jaccard(known(x), known(y)) >= least for x, y in texts]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def classes(
    docs: DataFrame, size: int = SHINGLE_WORDS, least: float = SIMILARITY, band_slots: int = BAND_SLOTS, bands: int = BANDS
) -> DataFrame:
    """(doc_id, class_id, copy_of): the least doc_id of the class, and of the equal texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    signed = rows.mapInArrow(lambda it: _signatures(it, size, band_slots, bands), SIGNATURES)
    signed = scratch.put("signed", signed)
    copies = signed.where("doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    copies = scratch.put("copies", copies)
    members = copies.select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"))
    # rows that repeat a doc_id give its text once
    lookup = rows.where("doc_id is not null")

    texts_: list[DataFrame] = []

    def held(ids: DataFrame) -> DataFrame:
        """Texts of the first call's ids: those of later calls are among them."""
        if not texts_:
            ids = scratch.put("needed", ids.select(F.col("id").alias("doc_id")).distinct())
            own = marked(lookup, "doc_id", marks(ids, "doc_id")).join(ids, "doc_id", "left_semi")
            texts_.append(scratch.put("texts", own.groupBy("doc_id").agg(F.min("text").alias("text"))))
        return texts_[0]

    def verify(pairs: DataFrame) -> DataFrame:
        known = held(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
        left, right = (known.select(F.col("doc_id").alias(c), F.col("text").alias("t" + c)) for c in "ab")
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
        return both.mapInArrow(lambda it: _alike(it, size, least), "a long, b long")

    def texts() -> DataFrame:
        return texts_[0].select(F.col("doc_id").alias("id"), "text")

    found = link_buckets(members, verify, texts, lambda column: _shingles(column, size), least, scratch)
    scratch.drop("needed", "texts")
    reps = copies.join(found.select(F.col("id").alias("rep"), "root"), "rep", "left")
    reps = reps.select("d1", "d2", "rep", F.coalesce("root", "rep").alias("class_id"))
    own = signed.select("doc_id", "d1", "d2").join(reps, ["d1", "d2"], "left")
    known = F.col("doc_id").isNotNull()
    return own.select("doc_id", F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("rep")).alias("copy_of"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; a doc_id that repeats stays once, a null one always.

    All columns stay as they are.
    """
    kept = classes(docs).where("doc_id = class_id").select("doc_id").distinct()
    with_id = docs.where("doc_id is not null")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = with_id.join(kept, "doc_id", "left_semi").select(*columns).dropDuplicates(["doc_id"])
    return once.unionByName(docs.where("doc_id is null"))
