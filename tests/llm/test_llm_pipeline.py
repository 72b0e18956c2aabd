"""The whole pipeline on a small corpus, against a plain version of every stage."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from test_llm_operators import brute_classes, brute_targets, junk, prose, word_sets

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    """Documents, benchmark items, and which documents are junk."""
    items = [(k, prose(rng, 30)) for k in range(5)]
    rows, bad = [], set()
    for i in range(260):
        kind = i % 13
        if kind == 0:
            text = junk(rng, i // 13 % 4)
            bad.add(i)
        elif kind == 1 and i > 13:
            words = rows[i - 3][1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif kind == 2 and i > 13:
            text = rows[i - 8][1]
        elif kind == 3:
            text = f"{prose(rng, 40)} {items[i % 5][1]} {prose(rng, 40)}"
        else:
            text = prose(rng, rng.randint(40, 160))
        rows.append((i, text, "en", f"s{rng.randrange(4)}", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    bad |= {900, 901}
    return rows, items, bad


def test_pipeline(spark, tmp_path):
    rows, items, bad = corpus(random.Random(5))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = [(i, t) for i, t, *_ in rows if i not in bad]
    classes = brute_classes(word_sets(good))
    own = {i: t for i, t in good if classes[i] == i}
    clean = {i: t for i, t in own.items() if not any(text in t for _, text in items)}
    source = {i: s for i, _, _, s, _ in rows}
    size = {i: len(t.split()) for i, t in clean.items()}
    totals = Counter()
    for i in clean:
        totals[source[i]] += size[i]

    copies = Counter(r["doc_id"] for r in got)
    assert set(copies) <= set(clean) and max(copies.values()) <= 3
    taken = Counter()
    for i, n in copies.items():
        taken[source[i]] += n * size[i]
    for s, target in brute_targets(totals).items():
        assert abs(taken[s] - target) <= min(size[i] for i in clean if source[i] == s)

    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        ids = np.array(encode(clean[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(corpus(random.Random(6))[0][:60], DOCS)
    for _, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[1], corpus_pipeline.STAGES[3]):
        assert stage(spark, docs, "").schema == docs.schema
