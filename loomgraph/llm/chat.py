"""Conversations as training text with a loss mask that follows token offsets.

A conversation is rendered whole: ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` and a line
feed for each turn. The three marks are special tokens of the tokenizer, so no token lies
across the edge of a text. Wherever a role or text has ``<``, any number of backslashes
and ``|``, one more backslash goes before the bar; this can be undone, and no text can
forge a mark.

The rendered text is encoded once, with offsets. Turn spans and token spans are both
sorted; a binary search finds the span each token starts in, and tokens that lie in
the text of a trained role are under the loss mask.

Edge cases: a null text or role counts as empty; an empty trained text has no token under
the mask; turns without a number come first, equal numbers are ordered by role and text;
equal rows are turns of their own; rows without a conv_id form one conversation; an
empty table gives no rows; other columns are ignored. A conversation is a single output
row and has to fit into a task's memory.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED = ("assistant",)

FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"

_FORGED = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _FORGED.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns, and the sorted spans of trained texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = f"{TURN}{escape(role)}{TEXT}"
        if role in trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURNS.findall(formatted)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in a span; both are sorted."""
    if not spans:
        return np.zeros(len(starts), bool)
    low, high = np.array(spans).T
    k = np.searchsorted(low, starts, "right") - 1
    return (k >= 0) & (ends <= high[np.maximum(k, 0)]) & (ends > starts)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, with the marks as special tokens of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    out = Tokenizer.from_file(path)
    out.add_special_tokens([AddedToken(t, normalized=False) for t in (TURN, TEXT, END)])
    return out


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame, path: str, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Render, encode and mask all conversations of ``rows`` (conv_id, turn, role, text), as FORMATTED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        kinds = {"formatted": pa.string(), "ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "loss": pa.list_(pa.bool_())}
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part, out = batch.slice(low, 256), {k: [] for k in kinds}
                for turns in part.column("turns").to_pylist():
                    text, spans = render([(t["role"], t["text"]) for t in turns], trained)
                    encoded = encode(text, add_special_tokens=False)
                    offsets = np.array(encoded.offsets, np.int32).reshape(-1, 2)
                    row = (text, np.array(encoded.ids, np.int32), offsets[:, 0], offsets[:, 1], mask(offsets[:, 0], offsets[:, 1], spans))
                    for k, v in zip(kinds, row, strict=True):
                        out[k].append(v)
                yield pa.record_batch([part.column("conv_id"), *(pa.array(out[k], t) for k, t in kinds.items())], names=["conv_id", *kinds])

    return conversations(rows).mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars) from the output alone.

    Turns come from the rendered text; loss_texts are the runs of tokens under the mask,
    decoded and unescaped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokenizer(path).decode
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                turns, losses, sizes = [], [], []
                for text, ids, loss in zip(*(part.column(c) for c in ("formatted", "ids", "loss")), strict=True):
                    text, ids = text.as_py(), np.asarray(ids.values)
                    under = np.asarray(loss.values).astype(np.int8) if len(ids) else np.zeros(0, np.int8)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], under, [0]))))
                    losses.append([unescape(decode(ids[a:b].tolist(), skip_special_tokens=False)) for a, b in zip(edge[::2], edge[1::2], strict=True)])
                    turns.append([{"role": r, "text": t} for r, t in parse(text)])
                    sizes.append(len(text))
                kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                yield pa.record_batch(
                    [part.column("conv_id"), pa.array(turns, kind), pa.array(losses, pa.list_(pa.string())), pa.array(sizes, pa.int64())],
                    names=["conv_id", "turns", "loss_texts", "formatted_chars"],
                )

    return formatted.mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, loss_texts array<string>, formatted_chars long")


def digest(back: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
