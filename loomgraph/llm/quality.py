"""Quality classifier from weak labels.

Nine heuristics vote on every document: good, bad, or no opinion. They overlap and
err; expectation-maximisation over the vote patterns of the whole corpus estimates
how often each of them is right, without any gold label, and gives each document a
posterior. There are at most 3**9 patterns, so their counts are a bounded table.

The posteriors are the labels of a linear scorer over hashed style features: grams
of character classes, repetition and length of words. It is a weighted logistic
regression fitted on a sample of about ``TRAIN_ROWS`` documents, chosen by a hash;
it then scores every whole text.

Edge cases: a text without words (null, empty, blank) scores 0 and is rejected;
other short texts are scored as any; a null doc_id is a value like another; equal
rows get equal scores; an empty table gives no rows, and a corpus that the weak
labels leave in one class keeps all documents with words; other columns are
ignored by ``fit`` and ``scores`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import arrays
from loomgraph.llm.tables import Scratch

#: Hashed features, expected rows of the training sample, score from which a document stays.
FEATURES, TRAIN_ROWS, KEEP_FROM = 1024, 12_000, 0.5

#: For each heuristic: bad above, good below; between them it has no opinion.
LABELLERS = {
    "characters_not_lower_case": (0.2, 0.12),
    "marks_among_characters": (0.12, 0.08),
    "words_not_plain": (0.25, 0.1),
    "words_far_from_a_sentence_length": (4.0, 2.5),
    "words_repeat_the_last": (0.15, 0.08),
    "most_common_word": (0.3, 0.2),
    "shingles_seen_before": (0.45, 0.3),
    "longest_run_of_a_word": (4.0, 3.0),
    "few_different_words": (0.5, 0.3),
}
SHINGLE_WORDS = 5
#: With fewer words, shares say little: no opinion.
LEAST_WORDS = 20

_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _STOP, _SYMBOL, _OTHER = range(8)


def _class_table() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[:128] = _SYMBOL
    for c in range(128):
        s = chr(c)
        if s.islower():
            out[c] = _LOWER
        elif s.isupper():
            out[c] = _UPPER
        elif s.isdigit():
            out[c] = _DIGIT
    out[[0x20, 0x09, 0x0B, 0x0C]] = _BLANK
    out[[0x0A, 0x0D]] = _LINE
    out[[ord(c) for c in ".,;:!?'\"()-"]] = _STOP
    return out


_CLASSES = _class_table()
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


@dataclass
class _Slice:
    """A few documents of a batch."""

    data: np.ndarray
    offsets: np.ndarray

    def __post_init__(self):
        self.many = len(self.offsets) - 1
        self.rows = np.repeat(np.arange(self.many), np.diff(self.offsets))
        self.kinds = _CLASSES[self.data]
        self.hashes, self.bounds = arrays.words(self.data, self.offsets)
        self.counts = np.diff(self.bounds)
        self.owner = np.repeat(np.arange(self.many), self.counts)
        same = np.zeros(len(self.hashes), bool)
        same[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.owner[1:] == self.owner[:-1])
        self.same = same
        space = np.isin(self.kinds, (_BLANK, _LINE))
        first = ~space
        first[1:] &= space[:-1]
        heads = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        first[heads] = ~space[heads]
        number = np.cumsum(first) - 1
        per_word = lambda kinds: np.bincount(number[np.isin(self.kinds, kinds)], minlength=len(self.hashes))
        self.marks = per_word((_STOP, _SYMBOL))
        self.lettered = per_word((_LOWER, _UPPER, _OTHER)) > 0
        rows, shingles, _ = arrays.word_shingles(self.hashes, self.bounds, SHINGLE_WORDS)
        order = np.lexsort((shingles, rows))
        again = np.zeros(len(rows), bool)
        again[order[1:]] = (shingles[order[1:]] == shingles[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
        self.shingle_rows, self.again = rows, again

    def per_row(self, rows: np.ndarray, what: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rows if what is None else rows[what], minlength=self.many).astype(np.float64)


def _votes(s: _Slice) -> np.ndarray:
    """(rows, labellers): 1 good, -1 bad, 0 no opinion."""
    share = lambda part, whole: part / np.maximum(whole, 1)
    space = np.isin(s.kinds, (_BLANK, _LINE))
    marks = np.isin(s.kinds, (_STOP, _SYMBOL))
    inked = s.per_row(s.rows, ~space)
    order = np.lexsort((s.hashes, s.owner))
    by_word, by_row = s.hashes[order], s.owner[order]
    runs = np.flatnonzero(np.append(np.ones(min(1, len(order)), bool), (by_word[1:] != by_word[:-1]) | (by_row[1:] != by_row[:-1])))
    most = np.zeros(s.many)
    np.maximum.at(most, by_row[runs], np.diff(np.append(runs, len(order))))
    plain = (s.marks <= 1) & s.lettered
    breaks = np.flatnonzero(~s.same)
    longest = np.zeros(s.many)
    np.maximum.at(longest, s.owner[breaks], np.diff(np.append(breaks, len(s.same))))
    different = s.per_row(by_row[runs])
    sentence = share(s.counts, s.per_row(s.rows, _ENDS[s.data]))
    values = {
        "characters_not_lower_case": 1 - share(s.per_row(s.rows, np.isin(s.kinds, (_LOWER, _OTHER))), inked),
        "marks_among_characters": share(s.per_row(s.rows, marks), inked),
        "words_not_plain": 1 - share(s.per_row(s.owner, plain), s.counts),
        "words_far_from_a_sentence_length": np.abs(np.log2(np.maximum(sentence, 0.25) / 10)) * 2,
        "words_repeat_the_last": share(s.per_row(s.owner, s.same), s.counts),
        "most_common_word": share(most, s.counts),
        "shingles_seen_before": share(s.per_row(s.shingle_rows, s.again), s.per_row(s.shingle_rows)),
        "longest_run_of_a_word": longest,
        # words over the square root of the length, upside down
        "few_different_words": np.sqrt(s.counts) / np.maximum(different, 1),
    }
    out = np.zeros((s.many, len(LABELLERS)), np.int64)
    for k, (name, (bad, good)) in enumerate(LABELLERS.items()):
        out[:, k] = np.where(values[name] > bad, -1, np.where(values[name] < good, 1, 0))
    out[s.counts < LEAST_WORDS] = 0
    return out


def _style(s: _Slice, size: int) -> np.ndarray:
    """(rows, size) hashed features: square roots of shares in three groups.

    The groups: grams of four character classes, words by their marks, letters and
    whether they repeat the last one, and shingles by whether the text had them before.
    """
    out = np.zeros((s.many, size))
    groups = []
    n = len(s.data) - 3
    if n > 0:
        kinds = s.kinds.astype(np.uint64)
        inner = s.rows[3:] == s.rows[:-3]
        gram = ((kinds[:-3] * np.uint64(8) + kinds[1:-2]) * np.uint64(8) + kinds[2:-1]) * np.uint64(8) + kinds[3:]
        groups.append((s.rows[:-3][inner], gram[inner]))
    again = s.same.copy()
    again[1:] &= s.same[:-1]
    word = (s.same * 2 + again) * 8 + np.minimum(s.marks, 3) * 2 + s.lettered
    groups.append((s.owner, word.astype(np.uint64) + np.uint64(1 << 20)))
    groups.append((s.shingle_rows, s.again.astype(np.uint64) + np.uint64(1 << 21)))
    for rows, codes in groups:
        slot = (arrays.mix(codes) % np.uint64(size)).astype(np.int64)
        counts = np.bincount(rows * size + slot, minlength=s.many * size).reshape(s.many, size)
        out += np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, _Slice]]:
    data, offsets = arrays.utf8(batch.column("text"))
    for low, high in arrays.slices(offsets):
        part = offsets[low : high + 1]
        yield low, _Slice(data[part[0] : part[-1]], part - part[0])


@dataclass
class WeakLabels:
    """What expectation-maximisation found: share of good documents, and for each
    labeller that has an opinion the probabilities of bad and good given bad and good."""

    good: float
    given: np.ndarray  # (labellers, class, vote)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes in (-1, 0, 1)."""
        log = np.log([1 - self.good, self.good])[None, :].repeat(len(votes), axis=0)
        for k in range(votes.shape[1]):
            said = votes[:, k] != 0
            log[said] += np.log(self.given[k][:, (votes[said, k] > 0).astype(int)]).T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def all_patterns() -> np.ndarray:
    codes = np.arange(3 ** len(LABELLERS))
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> WeakLabels:
    """Expectation-maximisation over vote patterns and how often each occurs.

    A labeller counts as a little better than chance before any data; that also
    fixes which class is called good.
    """
    many = patterns.shape[1]
    prior = np.array([[8.0, 2.0], [2.0, 8.0]])
    total = patterns.sum(axis=1)
    good = np.where(total > 0, 0.95, np.where(total < 0, 0.05, 0.5))
    model = None
    for _ in range(rounds):
        share = (counts * good).sum()
        given = np.repeat(prior[None], many, axis=0)
        for k in range(many):
            for column, vote in enumerate((-1, 1)):
                hit = patterns[:, k] == vote
                given[k, 0, column] += (counts * (1 - good))[hit].sum()
                given[k, 1, column] += (counts * good)[hit].sum()
        given /= given.sum(axis=2, keepdims=True)
        model = WeakLabels((share + 1) / (counts.sum() + 2), given)
        new = model.posterior(patterns)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return model


@dataclass
class Model:
    """Posterior of each vote pattern, and the linear scorer fitted on them."""

    labels: WeakLabels
    good: np.ndarray
    weights: np.ndarray | None
    bias: float

    def marks(self, s: _Slice) -> np.ndarray:
        if self.weights is None:
            mark = np.ones(s.many)
        else:
            mark = 1 / (1 + np.exp(-np.clip(_style(s, len(self.weights)) @ self.weights + self.bias, -700, 700)))
        return np.round(np.where(s.counts > 0, mark, 0.0), 6)


def _codes(s: _Slice) -> np.ndarray:
    return ((_votes(s) + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)


def _fit_scorer(sample: DataFrame) -> tuple[np.ndarray | None, float]:
    """Weighted logistic regression on (features, good): each row counts for both classes."""
    sides = F.array(*[F.struct(F.lit(label).alias("label"), w.alias("w")) for label, w in ((1.0, F.col("good")), (0.0, 1 - F.col("good")))])
    both = sample.select(array_to_vector("features").alias("features"), F.explode(sides).alias("x")).select("features", "x.label", "x.w")
    mass = {r["label"]: r["w"] for r in both.groupBy("label").agg(F.sum("w").alias("w")).collect()}
    if min(mass.get(0.0, 0.0), mass.get(1.0, 0.0)) < 1:
        return None, 0.0
    fit = LogisticRegression(weightCol="w", regParam=1e-6, maxIter=100, standardization=False, tol=1e-8)
    model = fit.fit(both.where("w > 0"))
    return model.coefficients.toArray(), float(model.intercept)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Weak labels from all of ``docs``, and a scorer from about ``train_rows`` of them."""
    scratch = Scratch(docs.sparkSession, "quality")
    texts = _texts(docs)
    patterns = all_patterns()

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s in _slices(batch):
                yield pa.record_batch([pa.array(_codes(s)[s.counts > 0])], names=["pattern"])

    histogram = texts.mapInArrow(voted, "pattern long").groupBy("pattern").count()
    seen = {r["pattern"]: r["count"] for r in histogram.collect()}  # 3 ** labellers rows at most
    counts = np.array([seen.get(k, 0) for k in range(len(patterns))], np.float64)
    labels = fit_labels(patterns, counts)
    good = labels.posterior(patterns)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s in _slices(batch):
                x = _style(s, features)[s.counts > 0]
                ends = np.arange(0, x.size + 1, features, dtype=np.int32)
                yield pa.record_batch([pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.array(good[_codes(s)[s.counts > 0]])], names=["features", "good"])

    parts = 1_000_000
    drawn = F.abs(F.xxhash64("doc_id", "text") % parts) < int(min(1.0, train_rows / max(counts.sum(), 1)) * parts)
    sample = scratch.put("sample", texts.where(drawn).mapInArrow(featured, "features array<double>, good double"))
    weights, bias = _fit_scorer(sample)
    scratch.drop("sample")
    return Model(labels, good, weights, bias)


def scores(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, n_words, weak_label, score, keep) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, s in _slices(batch):
                mark = model.marks(s)
                columns = [batch.column("doc_id").slice(low, s.many), s.counts, np.round(model.good[_codes(s)], 6), mark, mark >= keep_from]
                yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["doc_id", "n_words", "weak_label", "score", "keep"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_words long, weak_label double, score double, keep boolean")


def accepted(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` whose score is high enough, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, s in _slices(batch):
                yield batch.slice(low, s.many).filter(pa.array(model.marks(s) >= keep_from))

    return docs.mapInArrow(run, docs.schema)
