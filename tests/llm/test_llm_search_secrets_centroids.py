"""Secret scan, centroid clustering and lexical search against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import centroids, lexical_search, secret_scan
from test_llm_operators import empty, frame, odd, odd_rows, prose  # noqa: F401

HEX, UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def run(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


# ---- 11 secrets


def plain_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        out += [(m.start(), 1, m.end())] * (len(m[0]) >= 20)
    for m in re.finditer(r"[0-9a-f]+", text):
        out += [(m.start(), 2, m.end())] * (len(m[0]) >= 24)
    return sorted(out)


def listed(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)


@pytest.fixture(scope="module")
def leaky():
    rng, rows = random.Random(3), odd_rows()
    for k in range(400):
        parts = [prose(rng, rng.randint(5, 40))]
        if k % 3 == 0:
            parts.append(rng.choice(["TOKEN", "Api_Key", "é secret", "apikey"]) + rng.choice([" = '", ": ", '": "', "=="]) + run(rng, HEX, 40) + "'")
        if k % 4 == 0:
            parts.append("AKIA" + run(rng, UPPER, rng.choice([15, 16, 16, 16, 16])))
        if k % 50 == 7:
            parts.append("bare " + run(rng, HEX, 22))  # too short for the rule
        if k % 50 == 8:
            parts.append("card " + run(rng, "0123456789", 16) + " internationalization.")
        parts.append(prose(rng, 20))
        rows.append((1000 + k, " ".join(parts), "s"))
    more = ["secret: token: abcdefg", "token=token=abcdef", "paſſword=abcdefgh toKen=abcdefgh", "AKIAKIA" + "A" * 20, "password = short", "f" * 24 + "g" + "0" * 23, "token: '" + "é" * 8]
    return rows + [(5000 + k, t, None) for k, t in enumerate(more)]


def test_secret_rules_equal_plain_matching(spark, leaky):
    df = frame(spark, leaky, clash=True)
    got = secret_scan.scan(df, secret_scan.Formats()).collect()
    want = []
    for doc, text, _ in leaky:
        base = plain_base(text)
        counts = [sum(s[1] == k for s in base) for k in range(3)]
        want.append((doc, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base), 0))
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_learnt_formats_find_what_rules_miss(spark, leaky):
    df = frame(spark, leaky)
    formats = secret_scan.fit(df)
    assert set(formats.kinds) == {0, 1, 2}
    texts = {doc: text or "" for doc, text, _ in leaky if doc is not None}
    found = {r.doc_id: r for r in secret_scan.scan(df, formats).collect() if r.doc_id is not None}
    for doc, r in found.items():
        spans = [(int(a), k, int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert [s for s in spans if s[1] != "format"] == [(a, secret_scan.KINDS[k], b) for a, k, b in plain_base(texts[doc])]
        added = [texts[doc][a:b] for a, k, b in spans if k == "format"]
        assert len(added) == r.n_format
        bare = re.findall(r"bare ([0-9a-f]{22})\b", texts[doc])
        short = re.findall(r"\bAKIA[A-Z0-9]{15}(?![A-Z0-9])", texts[doc])
        assert set(bare) <= set(added) <= set(bare) | set(short), (doc, added)
    assert sum(r.n_format for r in found.values()) >= 8


def test_secret_sample_does_not_depend_on_partitions(spark, leaky):
    df = frame(spark, leaky)
    a, b = secret_scan.sampled(df.repartition(7), 60), secret_scan.sampled(df.coalesce(1), 60)
    assert a == b and all(len(v) <= 60 for v in a.values()) and len(a[2]) == 60


def test_automaton_keeps_prefixes_and_merges_random_rests():
    rng = random.Random(5)
    words = [("AKIA" + run(rng, UPPER, 16)).encode() for _ in range(800)]
    automaton = secret_scan.PrefixTree(words, secret_scan.ALPHA).automaton()
    assert 5 <= len(automaton.steps) <= 12
    assert [*automaton.steps[0]] == [ord("A")]
    total = lambda w: sum(automaton.score(w.encode()))
    assert total("AKIA" + run(rng, UPPER, 16)) > total("BKIA" + run(rng, UPPER, 16)) + 20
    assert total("AKIA" + run(rng, UPPER, 16)) > total("AKIA" + run(rng, "abcdef", 16)) + 10  # 16 * log(67 / 36) and an unseen step


def test_secret_scan_without_labels(spark, empty):  # noqa: F811
    assert secret_scan.scan(empty, secret_scan.fit(empty)).count() == 0
    few = frame(spark, [(1, "token = abcdefgh", "a"), (1, "token = abcdefgh", "a"), (2, None, None)])
    formats = secret_scan.fit(few)
    assert not formats.kinds
    assert sorted(r.n_assign for r in secret_scan.scan(few, formats).collect()) == [0, 1, 1]


# ---- 12 centroids


def plain_clusters(rows, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centers = [v for _, v in sorted(kept, key=name)[:8]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        groups = [[] for _ in centers]
        for _, v in kept:
            groups[place(v)[1]].append(v)
        centers = [[sum(col) // len(g) for col in zip(*g, strict=True)] if g else c for g, c in zip(groups, centers, strict=True)]
    placed = [(i, *place(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, k, d in placed:
        sums[k] += d
    return [(i, k, d, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()) for i, k, d in placed]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance int")


def test_centroids_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    base = np.float32(rng.normal(0, 0.2, (60, 64)) + rng.integers(0, 5, 60)[:, None] * 0.1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(100 + k, rows[3][1]) for k in range(30)] + [(3, rows[3][1]), (None, rows[5][1])]  # a hot vector, a repeated row, no id
    bad = list(rows[0][1])
    rows += [(200, None), (201, []), (202, rows[0][1][:63]), (203, bad[:63] + [None]), (204, bad[:63] + [float("nan")]), (205, bad[:63] + [float("-inf")])]
    order = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, centroids.cluster(vectors(spark, rows)).collect()), key=order) == sorted(plain_clusters(rows), key=order)


def test_centroids_of_few_or_extreme_vectors(spark):
    assert centroids.cluster(vectors(spark, [])).count() == 0
    few = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.25] * 64)]
    got = sorted(map(tuple, centroids.cluster(vectors(spark, few)).collect()))
    assert got == sorted(plain_clusters(few))
    far = centroids.cluster(vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)]), clusters=1).collect()
    assert len(far) == 2 and all(r.distance > 0 for r in far)


# ---- 13 lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, top=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(i, TERM.findall((t or "").translate(lower))) for i, t in docs]
    words = [(i, w, Counter(w)) for i, w in words if w]
    n, total, df = len(words), sum(len(w) for _, w, _ in words), Counter(t for _, _, c in words for t in c)
    out = []
    for item, text in items:
        asked, found = TERM.findall((text or "").translate(lower)), []
        for i, w, c in words:
            m = 75 + 25 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            found += [(-score, i is None, i)] * (score > 0)
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, f[2], -f[0]) for k, f in enumerate(found[:top])]
    return out


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], "item_id long, text string, item long")


@pytest.fixture(scope="module")
def library():
    rng = random.Random(8)
    docs = [(i, t) for i, t, _ in odd_rows()]
    docs += [(100 + k, prose(rng, rng.randint(1, 60)) + rng.choice(["", " Ünïcode ÀB", " zulu9 x-ray_q"])) for k in range(300)]
    docs += [(1000 + k, docs[20][1]) for k in range(150)] + [(2000, "the " * 5000), (120, docs[30][1])]
    items = [(k, prose(rng, rng.randint(1, 90))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "!?"), (53, "the the THE zulu9"), (54, docs[20][1]), (54, docs[20][1]), (None, "ünïcode Ünïcode àb ÀB"), (55, " ".join(f"w{k}" for k in range(200)) + " river x")]
    return docs, items


@pytest.mark.parametrize("first, block", [(50_000, 8192), (60, 64)])
def test_search_equals_scoring_everything(spark, library, monkeypatch, first, block):
    docs, items = library
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    df = frame(spark, [(i, t, "s") for i, t in docs], clash=True).repartition(3)
    got = sorted(map(tuple, lexical_search.search(df, items_frame(spark, items), first=first).collect()), key=str)
    assert got == sorted(plain_search(docs, dict.fromkeys(items)), key=str)


def test_search_in_slices_and_on_nothing(spark, library, empty, monkeypatch):  # noqa: F811
    docs, items = library
    monkeypatch.setattr(lexical_search, "SLICE", 1500)
    df = frame(spark, [(i, t, "s") for i, t in docs])
    assert sorted(map(tuple, lexical_search.search(df, items_frame(spark, items)).collect()), key=str) == sorted(plain_search(docs, dict.fromkeys(items)), key=str)
    assert lexical_search.search(empty, items_frame(spark, items)).count() == 0
    assert lexical_search.search(df, items_frame(spark, [])).count() == 0


def test_search_evaluates_few_documents(library):
    docs, items = library
    part = lexical_search.Items.build([(1, "zulu9 river stone")])
    rows = [(i, Counter(lexical_search.terms_of(t)), len(lexical_search.terms_of(t))) for i, t in docs if t]
    entries = [(k, part.vocabulary[t], c) for k, (_, tally, _) in enumerate(rows) for t, c in tally.items() if t in part.vocabulary]
    row, term, count = (np.array(x, np.int64) for x in zip(*entries, strict=True))
    n = np.array([r[2] for r in rows], np.int64)
    stats = lexical_search.Statistics(len(rows), int(n.sum()), np.array([3000, 10, 10]))
    block = lexical_search.Block(np.arange(len(rows)), np.zeros(len(rows), bool), n, row, term, count, stats)
    seen, ranks = [], lexical_search.Ranks(np.ones(1, np.int64), 20)
    scores = block.scores
    block.scores = lambda d, *a: (seen.extend(d.tolist()), scores(d, *a))[1]
    ranks.rank(block, part, stats)
    rare = part.vocabulary[b"zulu9"]
    assert 20 <= len(seen) <= (term == rare).sum() < len(rows) and all((row[term == rare] == d).any() for d in seen)
