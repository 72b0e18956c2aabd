"""Numpy helpers against plain Python."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import arrays, chat, licenses, line_dedup, near_dedup, passages, token_records

texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab Ä\n\tß.é|<\\ 日"), max_size=40)), min_size=0, max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_runs_without_ascii_space(rows):
    data, offsets = arrays.utf8(pa.array(rows, pa.string()))
    hashes, bounds = arrays.words(data, offsets)
    split = [[w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w] for t in rows]
    assert np.diff(bounds).tolist() == [len(w) for w in split]
    named = {}
    for word, h in zip((w for ws in split for w in ws), hashes.tolist(), strict=True):
        assert named.setdefault(word, h) == h
    assert len(set(named.values())) == len(named)


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 5))
def test_word_shingles(rows, size):
    data, offsets = arrays.utf8(pa.array(rows, pa.string()))
    hashes, bounds = arrays.words(data, offsets)
    owner, shingles, distinct = arrays.word_shingles(hashes, bounds, size)
    want = []
    for k in range(len(rows)):
        own = hashes[bounds[k] : bounds[k + 1]].tolist()
        width = min(size, len(own))
        want += [(k, tuple(own[i : i + width])) for i in range(len(own) - width + 1) if width]
    assert owner.tolist() == [k for k, _ in want]
    assert distinct.tolist() == [len(set(s)) for _, s in want]
    seen = {}
    for (_, s), h in zip(want, shingles.tolist(), strict=True):
        assert seen.setdefault(s, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_plain_form(rows):
    codes, offsets, own = arrays.plain(rows)
    for k, t in enumerate(rows):
        got = codes[offsets[k] : offsets[k + 1]]
        assert "".join(map(chr, got)) == " ".join((t or "").lower().split())
        for c, i in zip(got.tolist(), own[offsets[k] : offsets[k + 1]].tolist(), strict=True):
            assert chr(c) == (t[i].lower() if not t[i].isspace() else " ")


@pytest.mark.parametrize("q", [1, 3, 7, 8])
def test_grams_are_equal_where_text_is(q):
    text = np.array([random.Random(q).randrange(3) for _ in range(400)], np.uint32)
    got = arrays.grams(text, q).tolist()
    seen = {}
    for i, h in enumerate(got):
        assert seen.setdefault(tuple(text[i : i + q]), h) == h
    assert len(set(seen.values())) == len(seen)


def _edits(pattern, text, low, high, first, width):
    """Least edits of the pattern against any piece of text, on the given diagonals."""
    inf = 10**6
    rows = [[0 if True else inf for _ in range(width)]]
    for i, p in enumerate(pattern):
        row = []
        for c in range(width):
            at = first + c + i
            same = low <= at < high and text[at] == p
            best = rows[-1][c] + (not same)
            if c + 1 < width:
                best = min(best, rows[-1][c + 1] + 1)
            if c:
                best = min(best, row[c - 1] + 1)
            row.append(best)
        rows.append(row)
    return min(rows[-1])


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(60):
        text = np.array([rng.randrange(4) for _ in range(60)], np.uint32)
        low, high = sorted(rng.sample(range(61), 2))
        patterns = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(4)]
        sizes = np.array([len(p) for p in patterns])
        grid = np.zeros((4, sizes.max()), np.uint32)
        for k, p in enumerate(patterns):
            grid[k, : len(p)] = p
        first = np.array([rng.randint(low - 3, high) for _ in patterns])
        edits, start, end = arrays.edit_alignments(text, np.full(4, low), np.full(4, high), grid, sizes, first, 6)
        for k, p in enumerate(patterns):
            assert edits[k] == _edits(p, text, low, high, first[k], 6)
            assert low <= start[k] and end[k] <= high


def test_winnowing_shares_a_fingerprint_with_every_long_run():
    rng = random.Random(5)
    for _ in range(40):
        run = [rng.randrange(5) for _ in range(licenses.GRAM + licenses.WINDOW - 1)]
        a = np.array([rng.randrange(5) for _ in range(30)] + run + [rng.randrange(5) for _ in range(9)], np.uint32)
        b = np.array(run + [rng.randrange(5) for _ in range(25)], np.uint32)
        ga, gb = arrays.grams(a, licenses.GRAM), arrays.grams(b, licenses.GRAM)
        assert set(ga[licenses.winnow(ga)].tolist()) & set(gb[licenses.winnow(gb)].tolist())
    assert len(licenses.winnow(np.zeros(0, np.uint64))) == 0
    assert len(licenses.winnow(np.array([3, 1], np.uint64))) == 1


def test_prob_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    universe = rng.integers(0, 2**63, 60).astype(np.uint64)
    weight = rng.integers(1, 6, 60)
    a, b = np.arange(0, 45), np.arange(15, 60)
    rows = np.concatenate((np.zeros(45, int), np.ones(45, int)))
    signature = near_dedup.prob_minhash(rows, universe[np.concatenate((a, b))], weight[np.concatenate((a, b))], 2, 4096)
    exact = weight[15:45].sum() / weight.sum()
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.04
    one = near_dedup.prob_minhash(np.zeros(1, int), universe[:1], weight[:1], 1, 64)
    assert (one == universe[0]).all()


def test_line_minhash_estimates_jaccard():
    rng = np.random.default_rng(2)
    universe = rng.integers(0, 2**63, 80).astype(np.uint64)
    rows = np.concatenate((np.zeros(60, int), np.ones(60, int)))
    signature = line_dedup.minhash(rows, universe[np.concatenate((np.arange(60), np.arange(20, 80)))], 2, 4096)
    assert abs((signature[0] == signature[1]).mean() - 0.5) < 0.04


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<|\\ab>turn"), max_size=30))
def test_escape_is_reversible_and_hides_marks(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(mark in chat.escape(text) for mark in (chat.TURN, chat.TEXT, chat.END))


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tİΣς's3é日́​  .a<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_word_memo_gives_the_ids_of_the_whole_text(text):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    fast, slow = token_records.Encoding(path, words_apart=True), token_records.Encoding(path)
    assert token_records.encode(text, fast) == token_records.encode(text, slow)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'stremvld'S0 19.,!<|>-_"), st.characters(max_codepoint=130)), max_size=60), st.sampled_from(["", "<|endoftext|>", "it's <|startoftext|>s"]))
def test_pieces_give_the_ids_of_the_whole_text(text, added):
    from loomgraph.llm import queries

    fast = queries.encoding()
    slow = token_records.Encoding(fast.tokenizer)
    for whole in (text + added, text[:9] + added + text[9:]):
        assert token_records.encode(whole, fast) == token_records.encode(whole, slow)


def test_ascii_texts_skip_the_normalizer(monkeypatch):
    from loomgraph.llm import queries

    how = queries.encoding()
    monkeypatch.setattr(token_records._Memo, "learn", lambda *_: pytest.fail("encoded by the whole tokenizer"))
    assert len(token_records.encode("Don't panic:\n42 words, 'Quoted'.", how)) > 20


def test_frames():
    data = token_records.frame(b"abc")
    assert token_records.unframe(data) == b"abc"
    for k in range(len(data)):
        with pytest.raises(ValueError):
            token_records.unframe(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])
    with pytest.raises(ValueError):
        token_records.unframe(data[:5])


def test_plausible_candidates_are_counted_as_by_the_lemma():
    rng = np.random.default_rng(6)
    index, _ = licenses.build_index(licenses.TEMPLATES)
    long = np.flatnonzero(index.sizes >= 100)
    passage = np.sort(rng.choice(long, 60))
    parts = [np.where(rng.random(len(index.passages[k])) < rate, 120, index.passages[k]) for k, rate in zip(passage, itertools.cycle([0.0, 0.1, 0.2, 0.5]))]
    codes = np.concatenate(parts).astype(np.uint32)
    first = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])) - index.budgets[passage]
    text, want = arrays.grams(codes, 4), []
    for k, start in zip(passage, first):
        near = text[max(0, start) : start + index.sizes[k] + 2 * (index.budgets[k] + 1)]
        want.append(np.isin(arrays.grams(index.passages[k], 4), near).sum() >= index.sizes[k] - 3 - 4 * index.budgets[k])
    got = passages._plausible(index, codes, passage, first)
    assert 0 < sum(want) < 60 and got[want].all() and got.sum() <= sum(want) + 2
    # Each passage is cut into grams once, for whatever number of texts.
    held = {k: index.short[k] for k in passage.tolist()}
    passages._plausible(index, codes, passage, first)
    assert all(index.short[k] is v for k, v in held.items())
