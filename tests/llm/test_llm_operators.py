"""Each operator on small tables: edge cases, and brute force where SQL has no twin."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, decontaminate, fingerprints, license_notices, licenses, line_dedup, linking, mixing, near_dedup, quality, queries, token_records, url_filter
from loomgraph.llm.tables import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ["id", "row", "bucket", "root", "size", "rep", "of", "key", "split", "copies", "start", "file", "d1", "bands", "range", "v", "keep", "score", "n"]

WORDS = "the of and river stone light under morning walked slowly toward every answer green window paper ocean bright carried letter simple garden between number captain winter".split()


def prose(rng, n):
    out = [rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(n)]
    text = " ".join(w.capitalize() + "." if k % 9 == 8 else w for k, w in enumerate(out))
    return re.sub(r"((?:\S+ ){40})", lambda m: m[1].rstrip() + "\n", text)


def frame(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, None if t is None else "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in CLASHING}) if clash else df


def odd_rows():
    long = prose(random.Random(9), 30_000)
    return [
        (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one", "b"), (4, "one", "b"), (5, long, "a"), (6, "x" * 50_000, None),
        (7, "Some words that are here twice. And more of them follow now", "b"), (8, "Some words that are here twice. And more of them follow now", "b"),
        (None, "No number here at all, but text.", "c"), (9, "\n\n", "c"), (10, "日本語 テキスト é́ \U0001f600", "d"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows(), clash=True)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def encoding():
    return token_records.Encoding(public_tokenizers.path("word_bpe_49k.json"), 1, 2, True)


# ---- 1 token records


def check_records(df, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(token_records.digest(token_records.written(df, encoding())).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i))
    at, left = 0, Counter((i, t or "") for i, t in docs)
    for r in got:
        fits = [
            k for k in left
            if k[0] == r["doc_id"] and left[k] and zlib.crc32(np.array(tok.encode(k[1], add_special_tokens=False).ids + [1], "<u4").tobytes()) == r["ids_crc32"]
        ]
        assert fits and r["start"] == at
        left[fits[0]] -= 1
        at += r["n_tokens"]


def test_token_records(spark, odd, empty):
    check_records(odd, [(i, t) for i, t, _ in odd_rows()])
    assert token_records.digest(token_records.written(empty, encoding())).count() == 0


def test_token_records_in_any_order(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 60)), "a") for i in range(200)]
    folder = new_folder(spark, "test")
    index = token_records.write(frame(spark, rows), folder, encoding())
    some = index.where("doc_id % 7 = 3").orderBy(F.rand(1))
    got = {r["doc_id"]: bytes(r["ids"]) for r in token_records.read(some, folder).collect()}
    assert sorted(got) == [i for i in range(200) if i % 7 == 3]
    for i, data in got.items():
        assert np.frombuffer(data, "<u4").astype("<u2").tobytes() == token_records.encode(rows[i][1], encoding())


# ---- 2 near-duplicates


def word_sets(texts):
    out = {}
    for i, t in texts:
        w = (t or "").lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_classes(sets, least=0.8):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        union = len(sets[a] | sets[b])
        if union == 0 or len(sets[a] & sets[b]) / union >= least:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_rows(rng):
    rows = []
    for base in range(25):
        words = prose(rng, rng.randint(30, 120)).split(" ")
        for copy in range(rng.randint(1, 8)):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((base * 10 + copy, " ".join(own), "a"))
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows(random.Random(4))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, rows)).collect()}
    want = brute_classes(word_sets([(i, t) for i, t, _ in rows]))
    assert len(set(want.values())) > 25
    assert got == want


def test_near_duplicates_edges(spark, odd, empty):
    got = defaultdict(list)
    for r in near_dedup.classes(odd).collect():
        got[r["doc_id"]].append(r["class_id"])
    assert got == {1: [1], 2: [1], 3: [1], 9: [1], 4: [4, 4], 5: [5], 6: [6], 7: [7], 8: [7], None: [None], 10: [10]}
    assert near_dedup.classes(empty).count() == 0
    kept = near_dedup.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 5, 6, 7, 10]


def test_members_that_only_meet_through_others(spark):
    """A chain: neighbours are alike, its ends are not."""
    rng = random.Random(8)
    words = prose(rng, 120).split(" ")
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words), "a"))
        words[k * 9 + 4] = f"new{k}"
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, rows)).collect()}
    assert got == brute_classes(word_sets([(i, t) for i, t, _ in rows]))
    assert set(got.values()) == {0}


def group_near_the_threshold(rng, many, stray):
    """Versions of one text, most pairs of them just below the threshold, and copies of one version."""
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(many):
        own = list(words)
        for at in rng.sample(range(200), rng.choice([2, 4, 6, 8])):
            own[at] = f"n{i}x{at}"
        rows.append((i, " ".join(own), "a"))
    first = rows[0][1].split(" ")
    for i in range(many, many + stray):
        own = list(first)
        own[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(own), "a"))
    return rows


@pytest.mark.parametrize("bounds", [(4096, 1 << 22), (16, 1 << 22), (4096, 20_000)])
def test_groups_just_below_the_threshold(spark, monkeypatch, bounds):
    """The same classes in one chunk and in many, whatever bounds them."""
    monkeypatch.setattr(linking, "MEMBERS", bounds[0])
    monkeypatch.setattr(linking, "CHARS", bounds[1])
    rows = group_near_the_threshold(random.Random(21), 90, 40)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(frame(spark, rows)).collect()}
    want = brute_classes(word_sets([(i, t) for i, t, _ in rows]))
    assert len(set(want.values())) > 10
    assert got == want


def test_shared_members_over_partitions_and_batches(spark, monkeypatch):
    """Buckets that span batches and partitions, small and large ones, and repeated rows."""
    monkeypatch.setattr(linking, "CROWD", 6)
    rng = random.Random(5)
    rows = [(b, i) for b in range(-40, 40) for i in range(rng.choice([1, 1, 2, 3, 9, 30]))]
    members = spark.createDataFrame(rows + rows[::3], "bucket long, id long")
    size = Counter(b for b, _ in rows)
    for batch in (1, 4, 7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = linking.shared_members(members).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        pairs = [(r["bucket"], r["id"]) for r in got]
        assert len(set(pairs)) == len(pairs)
        assert {x for x in rows if size[x[0]] > 1} <= set(pairs)
        assert all(r["crowded"] for r in got if size[r["bucket"]] in (1, 9, 30))
        assert len({b for b, _ in pairs if size[b] == 1}) <= 16


def test_sketches_lose_no_pair_and_leave_most_others_out(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    # Each row has 200 elements; buckets hold rows that share 190, 180, 178 (0.8), 150 or 100 of them.
    sets, want, bucket = [], [], []
    for k, common in enumerate([190, 180, 178, 150, 100] * 40):
        for _ in range(2):
            own = rng.integers(0, 2**63, 200 - common).astype(np.uint64)
            sets.append(np.concatenate((base[:common], own, own)))  # some of them twice
            bucket.append(k)
            want.append(common)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sizes, words = linking.sketches(rows, np.concatenate(sets), len(sets))
    assert (sizes == 200).all()
    shared = spark.createDataFrame([(b, i, False) for i, b in enumerate(bucket)], "bucket long, id long, crowded boolean")
    sketched = spark.createDataFrame([(i, *map(int, (sizes[i], *words[i]))) for i in range(len(sets))], "id long, " + ", ".join(f"{c} long" for c in linking.SKETCH))
    kept = Counter(want[r["id"]] for r in linking.plausible(shared, sketched, 0.8).collect())
    assert kept[190] == kept[180] == kept[178] == 80
    assert kept[100] == 0 and kept[150] < 20


def test_wide_sketches_tell_long_sets_apart(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 1500, np.uint64)
    sets, want = [], []
    for common in [1450, 1400, 1334, 1200, 1100] * 20:  # of 1,500: 1,334 are the threshold, 1,200 a similarity of 0.67
        for _ in range(2):
            sets.append(np.concatenate((base[:common], rng.integers(0, 2**64, 1500 - common, np.uint64))))
            want.append(common)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = spark.createDataFrame([(i // 2, i, False) for i in range(len(sets))], "bucket long, id long, crowded boolean")
    left = {}
    for words, names in ((linking.WORDS, linking.SKETCH), (linking.WIDE, linking.WIDE_SKETCH)):
        sizes, cells = linking.sketches(rows, np.concatenate(sets), len(sets), words)
        assert (sizes == 1500).all()
        sketched = spark.createDataFrame([(i, *map(int, (sizes[i], *cells[i]))) for i in range(len(sets))], "id long, " + ", ".join(f"{c} long" for c in names))
        left[words] = Counter(want[r["id"]] for r in linking.plausible(shared, sketched, 0.8).collect())
        assert left[words][1450] == left[words][1400] == left[words][1334] == 40
    assert left[linking.WORDS][1200] == left[linking.WORDS][1100] == 40  # 256 cells say nothing here
    assert left[linking.WIDE][1100] == 0 and left[linking.WIDE][1200] < 8


def test_crowds_of_one_task_are_searched_too(spark, monkeypatch):
    monkeypatch.setattr(linking, "MEMBERS", 400)
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 2**64, 300, np.uint64) for _ in range(320)]
    sets.append(np.append(sets[7][:290], rng.integers(0, 2**64, 10, np.uint64)))
    rows = np.repeat(np.arange(len(sets)), 300)
    sizes, cells = linking.sketches(rows, np.concatenate(sets), len(sets), linking.WIDE)
    sketched = spark.createDataFrame([(i, *map(int, (sizes[i], *cells[i]))) for i in range(len(sets))], "id long, " + ", ".join(f"{c} long" for c in linking.WIDE_SKETCH))
    shared = [(1, i, True) for i in range(len(sets))] + [(2, i, True) for i in range(401)] + [(3, 0, True), (3, 1, True), (4, 7, False), (4, 320, False)]
    shared = spark.createDataFrame(shared, "bucket long, id long, crowded boolean")
    left = linking.plausible(linking.less_crowded(shared), sketched, 0.8).collect()
    assert sorted(r["id"] for r in left if r["bucket"] == 1) == [7, 320]
    assert len([r for r in left if r["bucket"] == 2 and r["crowded"]]) == 401  # too many for one task: all stay
    assert sorted((r["bucket"], r["id"]) for r in left if r["bucket"] > 2) == [(4, 7), (4, 320)]


def test_unlike_long_lines_do_not_travel_with_their_texts(spark, monkeypatch):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(400)]
    rows = []
    for i in range(30):
        own = list(words[:120])
        for at in rng.sample(range(120), 16):  # two lines share about 0.6 of their shingles
            own[at] = rng.choice(words[120:])
        rows.append((i, " ".join(own), "a"))
    rows.append((30, rows[0][1].replace("a", "b", 1), "a"))
    asked, alike = [], line_dedup.link_buckets

    def linked(members, *rest):
        asked.append({r["id"] for r in members.collect()})
        return alike(members, *rest)

    monkeypatch.setattr(line_dedup, "link_buckets", linked)
    gone = line_dedup.drops(frame(spark, rows), band_slots=1).collect()
    assert [(r["doc_id"], r["dropped"]) for r in gone] == [(30, [0])]
    assert len(asked[0]) < 10  # but for those of the first and the last bucket, only the two that are alike


@pytest.mark.parametrize("many", [3, 40, 60, 400])
@pytest.mark.parametrize("sided", [False, True])
def test_forest_joins_what_all_pairs_join(many, sided):
    rng = np.random.default_rng(many)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.append(rng.choice(base, rng.integers(80, 120), replace=False), rng.integers(0, 2**63, k % 9).astype(np.uint64))) for k in range(many)]
    roots, sides = rng.integers(0, many, many), rng.integers(0, 2, many) if sided else None

    def classes(pairs):
        of = {r: r for r in range(many)}
        for x, y in pairs:
            old, new = of[roots[x]], of[roots[y]]
            of = {r: new if c == old else c for r, c in of.items()}
        return {frozenset(x for x in range(many) if of[roots[x]] == c) for c in of.values()} - {frozenset()}

    own = [set(s.tolist()) for s in sets]
    alike = [(x, y) for x in range(many) for y in range(x) if not (sided and sides[x] == sides[y]) and len(own[x] & own[y]) >= 0.8 * len(own[x] | own[y])]
    found = linking.forest(sets, roots, sides, 0.8)
    assert len(found) < many
    assert classes(found) == classes(alike)


# ---- 3 quality


def junk(rng, kind):
    words = prose(rng, 80).split()
    if kind == 0:
        return " ".join(w for w in words[:12] for _ in range(rng.randint(6, 20)))
    if kind == 1:
        return " ".join(w + rng.choice(["%%%", "***", "&&&", "$$$"]) for w in words)
    if kind == 2:
        return " ".join(w.upper() + "!!" for w in words)
    return " | ".join(words)


def test_quality_on_held_out_labels(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(25, 300)), "a") if i % 6 else (i, junk(rng, i // 6 % 4), "a") for i in range(600)]
    docs = frame(spark, rows)
    model = quality.fit(docs)
    fresh = [(i, prose(rng, rng.randint(25, 300)), "a") if i % 6 else (i, junk(rng, i // 6 % 4), "a") for i in range(300)]
    got = {r["doc_id"]: r["keep"] for r in quality.scores(frame(spark, fresh), model).collect()}
    wrong_clean = [i for i in got if i % 6 and not got[i]]
    missed = [i for i in got if i % 6 == 0 and got[i]]
    assert len(wrong_clean) <= 2 and len(missed) <= 2, (wrong_clean, missed)
    assert 0.75 < model.labels.good < 0.9
    marks = [(r["doc_id"], r["keep"], r["n_words"]) for r in quality.scores(odd, model).collect()]
    assert len(marks) == len(odd_rows()) and all(n or not keep for _, keep, n in marks)
    kept = quality.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(keep for _, keep, _ in marks)
    nothing = quality.fit(empty)
    assert quality.scores(empty, nothing).count() == 0
    assert [r["keep"] for r in quality.scores(frame(spark, [(1, "a word", "a"), (2, None, "a")]), nothing).orderBy("doc_id").collect()] == [True, False]


def test_weak_labels_find_labeller_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.7
    accuracy = [0.95, 0.9, 0.8, 0.75, 0.9, 0.85, 0.7, 0.95, 0.6]
    votes = np.stack([np.where(rng.random(len(good)) < a, good, ~good) * 2 - 1 for a in accuracy], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.good - 0.7) < 0.03
    assert all(abs(model.given[k, 1, 1] - a) < 0.05 for k, a in enumerate(accuracy))
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.97


# ---- 4 chat


def test_chat_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [
        (1, 0, "user", "<|end|> <\\|turn|> \\ </s>", 1), (1, 1, "assistant", " leading and trailing \n", 1), (1, 2, "assistant", "", 1), (1, 3, "assistant", "é日\U0001f600", 1),
        (2, None, None, None, 1), (2, 5, "assistant", None, 1), (2, 5, "assistant", "tie", 1), (3, 0, "assistant", "word " * 20_000, 1), (None, 0, "<|text|>", "x", 1),
        (4, 0, "user", "same", 1), (4, 0, "user", "same", 1),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    formatted = chat.format_conversations(df, path)
    got = {r["conv_id"]: r for r in chat.digest(chat.read_back(formatted, path)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for r in formatted.collect():
        assert all(r["formatted"][a:b] for a, b, m in zip(r["starts"], r["ends"], r["loss"], strict=True) if m)
    assert chat.format_conversations(df.limit(0), path).count() == 0


# ---- 5 decontamination


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_decontamination(spark, odd, empty):
    rng = random.Random(6)
    items = [(k, prose(rng, 30)) for k in range(12)] + [(12, prose(rng, 90)), (13, None), (14, ""), (15, "short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want, own = [], set(), [t for _, t in items[:12]]
    for i in range(80):
        text = prose(rng, rng.randint(20, 150))
        if i % 4 == 1:
            k = rng.randrange(12)
            piece = list(own[k])
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(piece))
                piece[at : at + 1] = rng.choice([[], [piece[at], "q"], ["z"]])
            piece = "".join(piece)
            piece = piece.upper().replace(" ", "\n  ") if i % 8 == 5 else piece
            text = f"{text} {piece} {prose(rng, 10)}"
            want.add((i, k))
        rows.append((i, text, "a"))
    docs = frame(spark, rows)
    found = decontaminate.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    for r in found:
        near = " ".join(rows[r["doc_id"]][1][r["spans"][0]["start"] : r["spans"][-1]["end"]].lower().split())
        assert distance(near, " ".join(own[r["item_id"]].lower().split())) <= 0.12 * len(near) + 2
    assert decontaminate.clean(docs, bench).count() == 80 - len(want)
    # half of a long item is enough
    half = items[12][1][: len(items[12][1]) // 2]
    part = decontaminate.leaks(frame(spark, [(1, f"{prose(rng, 40)} {half} {prose(rng, 40)}", "a")]), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in part] == [(1, 12)]
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == len(odd_rows())
    assert decontaminate.leaks(empty, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == 80
    sliced = decontaminate.SLICE
    try:
        decontaminate.SLICE = 400
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()} == want
    finally:
        decontaminate.SLICE = sliced


def test_excerpts_of_items(spark):
    rng = random.Random(16)
    items = [(0, prose(rng, 36)), (1, prose(rng, 60))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for k, text in items:
        words = text.split()
        for n in (20, 25, 30):
            for at in range(len(words) - n + 1):
                piece = " ".join(words[at : at + n])
                piece = piece.replace("e", "3", rng.randint(0, 4))
                rows.append((len(rows), f"{prose(rng, 15)} {piece} {prose(rng, 15)}", "a"))
                if len(piece) >= decontaminate.REGION * 5 // 4 - 1:
                    want.add((len(rows) - 1, k))
    assert len(want) > 0.95 * len(rows)
    docs = frame(spark, rows)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    # Brute force over every start of a region's length: nothing else is found.
    for i, k in found - want:
        codes = " ".join(items[k][1].lower().split())
        text = " ".join(rows[i][1].lower().split())
        size = decontaminate.REGION
        assert any(distance(codes[a : a + size], text[b : b + size]) <= 2 * size * decontaminate.RATE for a in range(0, len(codes) - size + 1, 5) for b in range(0, len(text) - size + 1, 5))
    assert want <= found
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).select("doc_id").collect()} == set(range(len(rows))) - {i for i, _ in found}


# ---- 6 licenses


def test_licenses(spark, odd, empty):
    rng = random.Random(7)
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 100)
    rows = [
        (1, prose(rng, 50) + "\nReleased under the  MIT license.\n" + prose(rng, 50)), (2, prose(rng, 90)), (3, "All rights reserved."),
        (4, prose(rng, 5) + " " + mit.replace("hereby", "herewith") + " " + prose(rng, 5)), (5, "Licensed under CC BY-NC 4.0."), (6, "all right, reserve it"),
    ]
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(frame(spark, [(i, t, "a") for i, t in rows])).collect()}
    assert set(got) == {(1, "MIT"), (3, "all-rights-reserved"), (4, "MIT"), (5, "CC-BY-NC-4.0")}
    assert got[3, "all-rights-reserved"]["coverage"] == 1.0 and 0.9 < got[4, "MIT"]["coverage"] < 1
    text, span = rows[0][1], got[1, "MIT"]["spans"][0]
    assert text[span["start"] : span["end"]] == "Released under the  MIT license."
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty).count() == 0
    assert licenses.scan(odd, []).count() == 0


def test_similar_licenses_in_one_text(spark):
    rng = random.Random(17)
    lines = {"CC-BY-4.0": "Licensed under CC BY 4.0.", "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    names = [own for n in (1, 2, 3) for own in itertools.permutations(lines, n)]
    texts = [prose(rng, 20) + "".join(f"\n{lines[name]}\n{prose(rng, 20)}" for name in own) for own in names]
    # neighbours without other text between them
    names.append(tuple(lines))
    texts.append(" ".join(lines.values()))
    got = licenses.scan(frame(spark, [(k, t, "a") for k, t in enumerate(texts)])).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == sorted((k, name) for k, own in enumerate(names) for name in own)
    for r in got:
        assert (r["coverage"], r["edits"]) == (1.0, 0)
        assert [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] == [lines[r["license"]]]


def test_licenses_that_share_sentences(spark):
    rng = random.Random(18)
    shared, more, other = (prose(rng, 20).replace(".", ",").replace("\n", " ") + "." for _ in range(3))
    templates = [("two", f"{shared} {other}"), ("three", f"{shared} {more} {other}"), ("else", f"{prose(rng, 60)} {shared}")]
    texts = [f"{shared} {other}", f"{shared} {more} {other}", f"{shared} {other}\n{prose(rng, 30)}\n{shared} {more} {other}"]
    got = licenses.scan(frame(spark, [(k, t, "a") for k, t in enumerate(texts)]), templates).collect()
    assert {(r["doc_id"], r["license"]): r["coverage"] for r in got} == {(0, "two"): 1.0, (1, "three"): 1.0, (2, "two"): 1.0, (2, "three"): 1.0}


def test_whole_texts_and_versions_of_licenses(spark):
    rng = random.Random(19)
    lines = {
        "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.", "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
        "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.", "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.", "CC-BY-3.0": "Licensed under CC BY 3.0.",
        "CC0-1.0": "Licensed under CC0 1.0.", "Apache-1.1": "Licensed under the Apache License, Version 1.1.", "BSD": "Licensed under the BSD License.",
    }
    cases = [*lines.items(), *license_notices.notices(), *license_notices.texts()]
    texts = [f"{prose(rng, 20)}\n{text}\n{prose(rng, 20)}" for _, text in cases]
    got = defaultdict(dict)
    for r in licenses.scan(frame(spark, [(k, t, "a") for k, t in enumerate(texts)]).repartition(8)).collect():
        got[r["doc_id"]][r["license"]] = r["coverage"]
    for k, (name, _) in enumerate(cases):
        # some whole texts also have this line
        assert set(got[k]) - {"all-rights-reserved"} == {name} and got[k][name] > 0.99, (name, got[k])


# ---- 7 lines


def line_set(line):
    line = " ".join(line.lower().split())
    n = min(line_dedup.SHINGLE_CHARS, len(line))
    return frozenset(line[k : k + n] for k in range(len(line) - n + 1)) if line else None


def test_line_dedup_against_brute_force(spark, odd, empty):
    rng = random.Random(11)
    pool = [" ".join(prose(rng, rng.randint(3, 25)).split()) for _ in range(60)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(pool)
            if rng.random() < 0.4:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("xyz") + line[at + rng.randint(0, 2) :]
            lines.append(rng.choice([line, line, line.upper(), "", "ok"]))
        rows.append((i, "\n".join(lines), "a"))
    places = [(i, k, line) for i, t, _ in rows for k, line in enumerate(t.split("\n")) if line.strip()]
    kinds = {}
    for _, _, line in places:
        kinds.setdefault(" ".join(line.lower().split()), line_set(line))
    classes = brute_classes(kinds)
    seen, want = set(), defaultdict(list)
    for i, k, line in sorted(places):
        c = classes[" ".join(line.lower().split())]
        if c in seen:
            want[i].append(k)
        seen.add(c)
    got = {r["row"]["doc_id"]: r for r in line_dedup.rewritten(frame(spark, rows)).collect()}
    assert {i: r["lines_dropped"] for i, r in got.items() if r["lines_dropped"]} == dict(want)
    for i, text, _ in rows:
        lines = text.split("\n")
        assert got[i]["text"] == "\n".join(line for k, line in enumerate(lines) if k not in want[i])
        assert (got[i]["lines_before"], got[i]["lines_after"]) == (len(lines), len(lines) - len(want[i]))
    out = line_dedup.dedup(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows())
    texts = {(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()}
    assert (1, None) in texts and (8, "") in texts and (4, "one") in texts and (9, "\n\n") in texts
    assert line_dedup.dedup(empty).count() == 0


def test_edits_that_lines_of_a_length_bear(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    # (length of the line, characters replaced in its middle, alike)
    cases = [(39, 1, True), (38, 1, False), (60, 1, True), (84, 6, True), (83, 6, False), (114, 6, True), (30, 1, False), (200, 6, True)]
    rows, want = [], {}
    for k, (n, changed, alike) in enumerate(cases * 5):
        line = "".join(rng.choice(letters) for _ in range(n))
        at = n // 2 - changed // 2
        rows.append((k, f"{line}\n{line[:at]}{'0123456789'[:changed]}{line[at + changed:]}", "a"))
        both = [line_set(x) for x in rows[-1][1].split("\n")]
        if min(map(len, both)) == n - line_dedup.SHINGLE_CHARS + 1:  # no shingle twice
            want[k] = [1] if alike else []
    got = {r["row"]["doc_id"]: r["lines_dropped"] for r in line_dedup.rewritten(frame(spark, rows)).collect()}
    assert len(want) > 30 and {k: got[k] for k in want} == want


# ---- 8 mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        want = {s: 3 * sizes[s] if s in full else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in full and want[s] > 3 * sizes[s]}
        if not over:
            return want
        full |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng, int(rng.paretovariate(0.9) * 4) % 3000), rng.choice(["a", "b", "é", "\U0001f600", "￿", None] + ["big"] * 12)) for i in range(500)]
    rows += [(900, None, "a"), (901, "", "none"), (902, "lone word", "tiny"), (903, "  ", "none")]
    docs = frame(spark, rows, clash=True)
    got = mixing.plan(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    totals = Counter()
    for i, _, s in rows:
        totals[s] += size[i]
    want, taken = brute_targets(totals), Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s in totals:
        least = min((size[i] for i, _, x in rows if x == s and size[i]), default=0)
        assert abs(taken[s] - want[s]) <= max(least, 1), (s, taken[s], want[s])
    again = mixing.plan(docs.repartition(5)).select("row.doc_id", "copies").collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mixing_edges(spark, odd, empty):
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.plan(odd).count() == len(odd_rows())
    assert mixing.mix(odd).columns == odd.columns


def test_rates_are_an_exponential_tilt(spark):
    """The dual's stationarity: rates meet the target and are exp(tilt * size)."""
    from loomgraph.llm.tables import Scratch

    rng = random.Random(3)
    sizes = [("a", rng.randint(1, 900), rng.randint(1, 5)) for _ in range(80)]
    total = sum(s * n for _, s, n in sizes)
    cells = spark.createDataFrame(sizes, "source string, size long, docs long")
    for share in (0.2, 1.0, 2.7):
        goals = spark.createDataFrame([("a", share * total)], "source string, target double")
        r = mixing.tilts(cells, goals, Scratch(spark, "test")).first()
        got = sum(n * s * min(3.0, np.exp(r["tilt"] * s / r["mean"])) for _, s, n in sizes)
        assert got == pytest.approx(share * total, rel=1e-8)


# ---- 9 fingerprints


def test_fingerprints_add_up(spark):
    rows = spark.createDataFrame([("a\nb\na", "b\na\na", "a\nb", "a")], "x string, y string, p string, q string")
    v = {c: fingerprints.vector(F.col(c)) for c in "xypq"}
    r = rows.select(
        (v["x"] == v["y"]).alias("order"), (fingerprints.combine(v["p"], v["q"]) == v["x"]).alias("insert"),
        (fingerprints.combine(v["x"], v["q"], -1) == v["p"]).alias("delete"), (v["p"] == v["x"]).alias("count"),
    ).first()
    assert (r["order"], r["insert"], r["delete"], r["count"]) == (True, True, True, False)


def test_fingerprint_edges(spark, odd, empty):
    got = fingerprints.compare(odd).collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [t or "" for _, t, _ in rows]
    want = Counter()
    for k, (i, _, _) in enumerate(rows):
        half, after = len(texts[k]) // 2, texts[(k + 1) % len(texts)]
        edited = texts[k][: len(texts[k]) - half] + after[:half]
        want[i, len(texts[k]), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.compare(empty).count() == 0
    alone = fingerprints.compare(frame(spark, [(3, "abcd. efgh", "a")])).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abcd. abcd.").hexdigest()[:0] + hashlib.sha256(b"abcd.abcd.").hexdigest()


def test_likeness_follows_the_share_of_sentences(spark):
    rng = random.Random(12)
    rows = []
    for n in (8, 60, 400, 3000):
        own = [prose(rng, 6) + str(k) for k in range(n)]
        rows.append((n, "\n".join(own), "\n".join(own[: n // 2] + [s + "x" for s in own[n // 2 :]])))
    df = spark.createDataFrame(rows, "n long, a string, b string")
    got = df.select("n", fingerprints.likeness(fingerprints.vector(F.col("a")), fingerprints.vector(F.col("b"))).alias("near")).collect()
    assert all(0.05 <= r["near"] <= 0.65 for r in got), got


# ---- 10 urls


def test_url_parts_and_rules(spark):
    urls = [
        ("HTTP://Ex.ORG/a?b#c", "ex.org", "/a"), ("x://h#f/", "h", ""), ("nothing", "", ""), (None, "", ""), ("a://b://c/d", "b:", "//c/d"), ("s://É.COM?x", "É.com", ""),
        ("s://www.example.org/es/1", "www.example.org", "/es/1"), ("s://example.org/en/1", "example.org", "/en/1"), ("s://notexample.org/es/", "notexample.org", "/es/"),
    ]
    df = spark.createDataFrame([(k, u, "h") for k, (u, _, _) in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(df, queries.RULES).collect()}
    assert [(got[k]["host"], got[k]["path"]) for k in range(len(urls))] == [(h, p) for _, h, p in urls]
    assert [(got[k]["rule"], got[k]["verdict"]) for k in (0, 6, 7, 8)] == [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow")]
    assert all(got[k]["rule"] is None for k in (1, 2, 3))
    assert url_filter.judge(df.limit(0), queries.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(df, []).collect()} == {"allow"}


def test_reputation_shrinks_and_blocks_bad_hosts(spark):
    rows = [("good.a.com", 200, 190), ("bad.a.com", 200, 4), ("new.a.com", 0, 0), ("few.a.com", 2, 0), ("x.b.co.uk", 50, 45), ("y.b.co.uk:80", 0, 0)]
    got = {r["host"]: r for r in url_filter.reputations(spark.createDataFrame(rows, "host string, n long, good long")).collect()}
    assert got["bad.a.com"]["upper"] < 0.5 < got["good.a.com"]["reputation"]
    assert 0.02 < got["few.a.com"]["reputation"] < got["new.a.com"]["reputation"] and got["few.a.com"]["upper"] > 0.02
    assert got["y.b.co.uk:80"]["reputation"] > got["new.a.com"]["reputation"]
