"""Token ids as length-delimited binary records with a separate offset index.

A record file is a row of frames, one for each document::

    length of the payload   unsigned 64 bits, little endian
    masked CRC-32 of these eight bytes
    payload: the document's token ids, little endian, 16 or 32 bits each
    masked CRC-32 of the payload

Masking rotates the checksum by 15 bits and adds a constant, so that payloads
that themselves hold checksums do not look intact by accident. The index is a
table with a row for each document: file, offset, frame length, and how many ids
all earlier documents have. With it, documents can be read in any order.

Documents are range-partitioned by id and each task writes one file with a name
of its own; only files named in the index count, so a task that is run again
leaves an unused file and never a half-written one, and ``write`` removes what
is unused. Files go to the folder through pyarrow's file systems.

Edge cases: a null text counts as empty and an empty text is a record with the
end id alone; a null doc_id comes first; rows that share a doc_id are ordered by
their text and equal rows each keep a record; an empty table gives an index
without rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.tables import new_folder

#: Most memoised words of a tokenizer in one Python worker, and the longest of them.
MEMO_WORDS, MEMO_CHARS = 200_000, 64

#: Fixed value of the record format: what masking adds.
MASK_DELTA = 0xA282EAD8

_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")

FRAMES = "doc_id long, n_tokens long, part int, file string, offset long, frame_bytes long, place long"
RECORDS = "doc_id long, n_tokens long, start long, ids binary"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _TAIL.pack(masked(length)), payload, _TAIL.pack(masked(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one frame; raises if a checksum or the length is wrong."""
    if len(data) < _HEAD.size + _TAIL.size:
        raise ValueError("record is cut short")
    length, check = _HEAD.unpack_from(data)
    if masked(data[:8]) != check:
        raise ValueError("the length of a record is damaged")
    if len(data) != _HEAD.size + length + _TAIL.size:
        raise ValueError("record and index differ in length")
    payload = data[_HEAD.size : _HEAD.size + length]
    if masked(payload) != _TAIL.unpack_from(data, _HEAD.size + length)[0]:
        raise ValueError("the ids of a record are damaged")
    return payload


@dataclass(frozen=True)
class Encoding:
    """How texts become ids.

    ``words_apart`` says that the tokenizer drops blanks and line feeds and never
    joins what they part; the text is then encoded word by word through a memo,
    which gives the same ids. ``pieces`` is the tokenizer's pattern for the pieces of
    lower-case ASCII text: such texts skip its normalizer and pre-tokenizer, and only
    new pieces go to its model.
    """

    tokenizer: str
    end_id: int | None = 1
    id_bytes: int = 2
    words_apart: bool = False
    pieces: str | None = None

    @property
    def dtype(self) -> str:
        return f"<u{self.id_bytes}"


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Memo(dict):
    """Packed ids of single words."""

    def __init__(self, how: Encoding):
        super().__init__()
        self.how, self.tokenizer = how, _tokenizer(how.tokenizer)

    def pack(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        if self.how.id_bytes == 2 and ids and max(ids) > 0xFFFF:
            raise ValueError("the vocabulary needs id_bytes=4")
        return np.array(ids, self.how.dtype).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode the words that are new all at once, a blank between them, and part the ids by offset."""
        new = [w for w in dict.fromkeys(words) if w not in self and len(w) <= MEMO_CHARS]
        if len(self) + len(new) > MEMO_WORDS:
            self.clear()
            new = [w for w in dict.fromkeys(words) if len(w) <= MEMO_CHARS]
        if self.how.pieces:
            pieces = _pieces(self.how)
            self.update((w, pieces.pack(w)) for w in new if pieces.take(w))
            new = [w for w in new if w not in self]
        if not new:
            return
        encoded = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        lengths = np.array([len(w) + 1 for w in new])
        word = np.searchsorted(np.cumsum(lengths) - lengths, np.array([a for a, _ in encoded.offsets], np.int64), "right") - 1
        packed, size = self.packed(encoded.ids), self.how.id_bytes
        edges = (np.searchsorted(word, np.arange(len(new) + 1)) * size).tolist()
        self.update((w, packed[edges[k] : edges[k + 1]]) for k, w in enumerate(new))

    def __missing__(self, word: str) -> bytes:
        return self.pack(word)  # too long to keep


class _Pieces(dict):
    """Packed ids of pieces that the tokenizer's model takes as they are."""

    def __init__(self, how: Encoding):
        super().__init__()
        tokenizer = _tokenizer(how.tokenizer)
        self.code, self.model, self.cut = "H" if how.id_bytes == 2 else "I", tokenizer.model, re.compile(how.pieces).findall
        self.added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]

    def take(self, text: str) -> bool:
        """Whether all of the text is ASCII that only ``pieces`` divides: no control characters and no added tokens."""
        return text.isascii() and text.replace("\n", " ").isprintable() and not any(a in text for a in self.added)

    def pack(self, text: str) -> bytes:
        if len(self) > MEMO_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, self.cut(text.lower())))

    def __missing__(self, piece: str) -> bytes:
        ids = [token.id for token in self.model.tokenize(piece)]
        try:
            packed = struct.pack(f"<{len(ids)}{self.code}", *ids)
        except struct.error as wide:
            raise ValueError("the vocabulary needs id_bytes=4") from wide
        if len(piece) <= MEMO_CHARS:
            self[piece] = packed
        return packed


@functools.lru_cache(maxsize=2)
def _pieces(how: Encoding) -> _Pieces:
    return _Pieces(how)


@functools.lru_cache(maxsize=2)
def _memo(how: Encoding) -> _Memo:
    return _Memo(how)


def encode(text: str | None, how: Encoding) -> bytes:
    """Packed ids of a whole text, with the end id."""
    memo, text = _memo(how), text or ""
    if how.pieces and _pieces(how).take(text):
        body = _pieces(how).pack(text)
    elif how.words_apart:
        words = text.replace("\n", " ").split(" ")
        memo.learn(words)
        body = b"".join(map(memo.__getitem__, words))
    else:
        body = memo.pack(text)
    return body if how.end_id is None else body + np.array([how.end_id], how.dtype).tobytes()


def write(docs: DataFrame, folder: str, how: Encoding) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``folder`` and return the index.

    The index is a table below the folder with the columns of ``FRAMES`` and
    ``start``: the number of ids of all documents before this one.
    """
    spark = docs.sparkSession
    place = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(place)
        part = TaskContext.get().partitionId()  # partitions of a range are in order
        name, out, offset, row = f"part-{part:05d}-{uuid.uuid4().hex}.rec", None, 0, 0
        for batch in batches:
            ids, counts, offsets, sizes = batch.column(0), [], [], []
            for text in batch.column(1):
                packed = encode(text.as_py(), how)
                data = frame(packed)
                out = out or system.open_output_stream(f"{root}/data/{name}")
                out.write(data)
                counts.append(len(packed) // how.id_bytes)
                offsets.append(offset)
                sizes.append(len(data))
                offset += len(data)
            n = len(counts)
            long = lambda x: pa.array(x, pa.int64())
            yield pa.record_batch(
                [ids, long(counts), pa.array([part] * n, pa.int32()), pa.array([name] * n, pa.string()), long(offsets), long(sizes), long(range(row, row + n))],
                names=["doc_id", "n_tokens", "part", "file", "offset", "frame_bytes", "place"],
            )
            row += n
        if out:
            out.close()

    system, root = fs.FileSystem.from_uri(place)
    system.create_dir(f"{root}/data", recursive=True)
    key = F.col("doc_id").cast("long").alias("doc_id")
    ordered = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, FRAMES).write.parquet(f"{place}/frames")
    frames = spark.read.schema(FRAMES).parquet(f"{place}/frames")
    starts(frames).write.parquet(f"{place}/index")
    used = {r[0] for r in frames.select("file").distinct().collect()}  # one name for each task
    for info in system.get_file_info(fs.FileSelector(f"{root}/data")):
        if info.base_name not in used:
            system.delete_file(info.path)
    return open_index(spark, folder)


def starts(frames: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before.

    Sums over files are one row for each file; the running sum inside a file is
    a window over the rows that one task wrote.
    """
    files = frames.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("file").alias("of"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = frames.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    joined = running.join(files, F.col("file") == F.col("of")).withColumn("start", F.col("start") + F.col("base"))
    return joined.drop("of", "base")


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(FRAMES + ", start long").parquet(f"{folder.rstrip('/')}/index")


def read(index: DataFrame, folder: str, id_bytes: int = 2) -> DataFrame:
    """Records of the given index rows, in any selection and order, as RECORDS.

    ``ids`` holds little-endian unsigned 32-bit ids. Checksums are verified.
    """
    place = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(place)
        name, source = None, None
        for batch in batches:
            out, size, taken = [], 0, 0
            for k, (file, offset, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "frame_bytes")), strict=True)):
                if file != name:
                    name, source = file, system.open_input_file(f"{root}/data/{file}")
                payload = unframe(source.read_at(length, offset))
                out.append(np.frombuffer(payload, f"<u{id_bytes}").astype("<u4").tobytes())
                size += len(out[-1])
                if size >= 1 << 24 or k + 1 == batch.num_rows:
                    counts = [len(x) // 4 for x in out]
                    part = batch.slice(taken, len(out))
                    yield pa.record_batch(
                        [part.column("doc_id"), pa.array(counts, pa.int64()), part.column("start"), pa.array(out, pa.binary())],
                        names=["doc_id", "n_tokens", "start", "ids"],
                    )
                    taken, out, size = k + 1, [], 0

    wanted = index.select("doc_id", "start", "file", "offset", "frame_bytes")
    files = max(1, wanted.select("file").distinct().count())
    # about a task for each file: rows of the index are small, what they point at is not
    spread = wanted.repartitionByRange(files, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(run, RECORDS)


def digest(records: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of records."""
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def written(docs: DataFrame, how: Encoding) -> DataFrame:
    """Write ``docs`` to a new folder of the shared checkpoint folder and read all records back."""
    folder = new_folder(docs.sparkSession, "token-records")
    return read(write(docs, folder, how), folder, how.id_bytes)
