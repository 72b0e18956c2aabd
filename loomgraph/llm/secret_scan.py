"""Secrets in texts: fixed rules, and formats learnt from what the rules find.

The values that the rules find are labelled credentials. Of each kind of them a bounded
sample goes into a prefix tree that counts its characters; states whose counts are
statistically compatible (Hoeffding bounds on every continuation, recursively) are merged
into a probabilistic automaton, the commonest first. A literal prefix stays a chain, a
random rest becomes a loop. The runs of the same characters that no rule touches are
candidates: another automaton is inferred from a sample of them, and a candidate is a
secret if its characters are as likely under a credential automaton as those of labelled
values that were held out, and it is more likely there than under the plain one, or as a plain number, by ``ODDS``.

The sample of a kind holds the ``SAMPLE`` distinct values of least hash in all documents:
it does not depend on partitions, and no task returns more. Everything else covers whole
texts of all documents. Texts are read twice; what crosses tasks are the samples.

Edge cases: a null or empty text has no secrets and the digest of an empty list; a kind
with fewer than ``LEAST`` labelled values gets no automaton (its rule still holds); without
candidates every character counts as equally likely; runs of any length are scored whole;
repeated rows, equal and null ids are rows of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import arrays
from loomgraph.llm.tables import Scratch

#: Kinds of spans, in the order in which they are listed; the last one is added by the automata.
KINDS = ("assign", "access", "hex", "format")
# The rules run on bytes: their characters are ASCII, and A-Z alone have another case.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")  # of a longer run of such characters, all of it
HEX = re.compile(rb"[0-9a-f]{24,}")
CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{10,}")
SHORTEST_VALUE, SHORTEST_CANDIDATE = 6, 10
#: Characters of values.
SYMBOLS = 67
#: Values of a kind that are learnt from at most, and at least; every fourth is held out.
SAMPLE, LEAST, HELD_OUT = 1500, 40, 4
#: Chance that two compatible states are kept apart; share of held-out values below the bound; odds against plain text.
ALPHA, LOW_SHARE, ODDS = 0.01, 0.02, 1e6


def rule_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, in bytes, by start."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text.lower()) if m.end() - m.start(1) >= SHORTEST_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def values(text: bytes, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, bytes]]:
    """(kind, labelled value) of the rules' spans."""
    for start, kind, end in spans:
        value = text[start:end]
        if kind == 0:
            value = text[start + ASSIGN.match(value.lower()).start(1) : end]
        yield kind, value


def candidates(text: bytes, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of value characters that no rule touches, without dots at their ends."""
    k, reach = 0, 0  # spans before k begin before the run ends; they reach up to here
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            reach = max(reach, spans[k][2])
            k += 1
        if reach > start:
            continue
        while start < end and text[start] == 0x2E:
            start += 1
        while end > start and text[end - 1] == 0x2E:
            end -= 1
        if end - start >= SHORTEST_CANDIDATE:
            yield start, end


# ---- automata


@dataclass
class Automaton:
    """For each state: symbol -> (next state, log likelihood), and the log likelihoods of an end and of anything unseen."""

    steps: list[dict[int, tuple[int, float]]]
    ends: list[float]
    unseen: list[float]

    def score(self, value: bytes) -> tuple[float, float]:
        """Log likelihood of a value's characters, and of its end after them."""
        state, total = 0, 0.0
        for at, symbol in enumerate(value):
            step = self.steps[state].get(symbol)
            if step is None:  # from here on all symbols are equally likely
                return total + self.unseen[state] - (len(value) - at) * math.log(SYMBOLS), 0.0
            state = step[0]
            total += step[1]
        return total, self.ends[state]


def uniform() -> Automaton:
    return Automaton([{}], [0.0], [0.0])


class PrefixTree:
    """Counted prefixes of values, and their merging into an automaton."""

    def __init__(self, words: Iterable[bytes], alpha: float):
        self.next: list[dict[int, list[int]]] = [{}]  # symbol -> [state, how often]
        self.ends, self.visits = [0], [0]
        self.margin = math.sqrt(math.log(2 / alpha) / 2)
        for word in words:
            state = 0
            self.visits[0] += 1
            for symbol in word:
                edge = self.next[state].get(symbol)
                if edge is None:
                    edge = self.next[state][symbol] = [len(self.next), 0]
                    self.next.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                edge[1] += 1
                state = edge[0]
                self.visits[state] += 1
            self.ends[state] += 1

    def unlike(self, a: int, b: int) -> float:
        """Largest difference between the continuations of two states, as a share of the bound; above 1 they differ."""
        worst, todo = 0.0, [(a, b)]
        while todo:
            a, b = todo.pop()
            m, n = self.visits[a], self.visits[b]
            if not m or not n:
                continue
            bound = self.margin * (m**-0.5 + n**-0.5)
            if bound >= 1:
                continue
            worst = max(worst, abs(self.ends[a] / m - self.ends[b] / n) / bound)
            of_a, of_b = self.next[a], self.next[b]
            for symbol in of_a.keys() | of_b.keys():
                x, y = of_a.get(symbol), of_b.get(symbol)
                worst = max(worst, abs((x[1] if x else 0) / m - (y[1] if y else 0) / n) / bound)
                if x and y:
                    todo.append((x[0], y[0]))
            if worst > 1:
                break
        return worst

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of a tree to a state and to what follows it."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for symbol, (state, n) in self.next[b].items():
                edge = self.next[a].get(symbol)
                if edge is None:
                    self.next[a][symbol] = [state, n]
                else:
                    edge[1] += n
                    todo.append((edge[0], state))

    def merged(self) -> list[int]:
        """The states that stay apart, the first one first."""
        kept, inside = [0], {0}
        while True:
            fringe = {edge[0]: edge for state in kept for edge in self.next[state].values() if edge[0] not in inside}
            if not fringe:
                return kept
            state = max(fringe, key=lambda s: (self.visits[s], -s))
            least, best = min((self.unlike(k, state), i) for i, k in enumerate(kept))
            if least <= 1:
                fringe[state][0] = kept[best]
                self.fold(kept[best], state)
            else:
                kept.append(state)
                inside.add(state)

    def automaton(self) -> Automaton:
        kept = self.merged()
        number = {state: k for k, state in enumerate(kept)}
        out = Automaton([], [], [])
        for state in kept:
            total = self.visits[state] + 1  # one for what was never seen
            out.steps.append({symbol: (number[to], math.log(n / total)) for symbol, (to, n) in self.next[state].items()})
            out.ends.append(math.log(max(self.ends[state], 1 / SYMBOLS) / total))
            out.unseen.append(-math.log(total))
        return out


@dataclass
class Format:
    """An automaton, and how likely a character of held-out values is: usually, and how much less at the low end of one character."""

    automaton: Automaton
    usual: float
    less: float

    @staticmethod
    def learn(words: list[bytes]) -> Format:
        """Every ``HELD_OUT``-th value is held out."""
        automaton = PrefixTree([w for k, w in enumerate(words) if k % HELD_OUT], ALPHA).automaton()
        each = sorted((automaton.score(w)[0] / len(w), len(w)) for w in words[::HELD_OUT])
        usual, (low, size) = each[len(each) // 2][0], each[int(LOW_SHARE * len(each))]
        return Format(automaton, usual, (usual - low) * math.sqrt(size))

    def gain(self, value: bytes) -> float:
        """Log likelihood of a value of this format; of any other minus infinity."""
        inside, end = self.automaton.score(value)
        fits = inside / len(value) >= self.usual - self.less / math.sqrt(len(value))
        return inside + end if fits else -math.inf


@dataclass
class Formats:
    """Formats of credentials, and the automaton of plain runs."""

    plain: Automaton = field(default_factory=uniform)
    kinds: dict[int, Format] = field(default_factory=dict)
    odds: float = ODDS

    def is_secret(self, value: bytes) -> bool:
        least = sum(self.plain.score(value))
        if value.isdigit():  # as a number
            least = max(least, -len(value) * math.log(10))
        least += math.log(self.odds)
        return any(f.gain(value) >= least for f in self.kinds.values())


def learn(sample: dict[int, list[bytes]], least: int = LEAST) -> Formats:
    """``sample`` holds values by kind, and candidates at the number of ``format``, each in an order of chance."""
    out, plain = Formats(), KINDS.index("format")
    for kind, words in sorted(sample.items()):
        if len(words) < least:
            continue
        if kind == plain:
            out.plain = PrefixTree(words, ALPHA).automaton()
        else:
            out.kinds[kind] = Format.learn(words)
    return out


# ---- over documents


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = arrays.utf8(batch.column("text"))
    for row in range(batch.num_rows):
        yield data[offsets[row] : offsets[row + 1]].tobytes()


def _hash(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "big") >> 1


class _Least:
    """The distinct values of least hash of each kind."""

    def __init__(self, size: int):
        self.size, self.heaps = size, [[] for _ in KINDS]
        self.inside: list[set[bytes]] = [set() for _ in KINDS]

    def add(self, kind: int, value: bytes) -> None:
        if value in self.inside[kind]:
            return
        heap, entry = self.heaps[kind], (-_hash(value), value)
        if len(heap) < self.size:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            self.inside[kind].discard(heapq.heappushpop(heap, entry)[1])
        else:
            return
        self.inside[kind].add(value)


def sampled(docs: DataFrame, size: int = SAMPLE) -> dict[int, list[bytes]]:
    """By kind the ``size`` distinct labelled values of least hash; last the candidates."""
    scratch = Scratch(docs.sparkSession, "secrets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _Least(size)
        for batch in batches:
            for text in _texts(batch):
                spans = rule_spans(text)
                for kind, value in values(text, spans):
                    least.add(kind, value)
                for start, end in candidates(text, spans):
                    least.add(3, text[start:end])
        rows = [(kind, -h, v) for kind, heap in enumerate(least.heaps) for h, v in heap]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "hash", "value"])

    found = docs.select("text").mapInArrow(run, "kind int, hash long, value binary").distinct()
    held = scratch.put("values", found)
    out = {}
    for kind in range(len(KINDS)):
        rows = held.where(F.col("kind") == kind).orderBy("hash", "value").limit(size).select("value").collect()  # ``size`` at most
        out[kind] = [bytes(r["value"]) for r in rows]
    scratch.drop("values")
    return out


def fit(docs: DataFrame, size: int = SAMPLE) -> Formats:
    """Formats of the credentials that the rules find in ``docs``."""
    return learn(sampled(docs, size))


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format) for each row of ``docs``; places are code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bool] = {}
        for batch in batches:
            counts, digests, every = [], [], []
            for text in _texts(batch):
                base = rule_spans(text)
                more = []
                for start, end in candidates(text, base):
                    value = text[start:end]
                    if (secret := known.get(value)) is None:
                        secret = formats.is_secret(value)
                        if len(value) < 64:
                            if len(known) >= 100_000:
                                known.clear()
                            known[value] = secret
                    if secret:
                        more.append((start, 3, end))
                if base or more:
                    starts = None if text.isascii() else np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                    place = (lambda b, s=starts: b) if starts is None else (lambda b, s=starts: int(s[b - 1]) if b else 0)
                    name = lambda spans, place=place: ",".join(f"{KINDS[k]}:{place(a)}:{place(z)}" for a, k, z in spans)
                else:
                    name = lambda spans: ""
                counts.append([sum(s[1] == k for s in base) for k in range(3)] + [len(more)])
                digests.append(hashlib.sha256(name(base).encode()).hexdigest())
                every.append(name(sorted(base + more)))
            table = np.array(counts, np.int64).reshape(-1, 4)
            columns = [batch.column("doc_id"), *[pa.array(table[:, k]) for k in range(3)], pa.array(digests, pa.string()), pa.array(every, pa.string()), pa.array(table[:, 3])]
            yield pa.record_batch(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
