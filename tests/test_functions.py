import re
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import fixed, ids, paths, text, urls
from loomgraph.functions.similarity import jaro_winkler_pair
from loomgraph.operators import classify, ledger


def one(spark, value, expr):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], "x string").select(expr.alias("y")).collect()]


def reference_id(s):
    s = re.sub(r"_+", "_", re.sub(r"[^\w]+", "_", unicodedata.normalize("NFKC", s)))
    return s.strip("_").casefold()


SAMPLES = ["Ünï codé-x", "Straße__No.1", "ﬁle Ⅳ", "ΑΣ", "a--b__c", "", "___", "日本 語", "éclair", "ABC", "¼ tank", "İx"]


def test_normalize_id(spark):
    got = one(spark, SAMPLES, ids.normalize_id("x"))
    assert got == [reference_id(s) for s in SAMPLES]
    stable = [g for g in got if "\u0307" not in g]  # casefolding a dotted capital I leaves a combining dot
    assert one(spark, stable, ids.normalize_id("x")) == stable


def test_make_id_parts(spark):
    row = spark.range(1).select(
        ids.make_id(F.lit("src"), F.lit(""), F.lit("_auth.")).alias("a"),
        ids.code_file_id(F.lit("/x/pkg/auth.py")).alias("b"),
        ids.code_file_id(F.lit("auth.py")).alias("c"),
        ids.document_id(F.lit("docs/auth.md")).alias("d"),
        ids.module_stem(F.lit("..a.b.c")).alias("e"),
    ).first()
    assert tuple(row) == ("src_auth", "pkg_auth", "auth", "auth_md", "c")


def test_title_matches_python(spark):
    values = ["x1y_don't", "auth_service", "a__b", "été_2fa"]
    assert one(spark, values, text.title_label("x")) == [v.replace("_", " ").strip().title() for v in values]


def test_label_forms(spark):
    assert one(spark, ["  .Foo() ", "(bar)", "Baz"], text.callable_key("x")) == ["foo", "bar", "baz"]
    assert one(spark, ["Straße()", "ΑΣ"], text.bare("x")) == ["strasse", "ας".casefold()]
    assert one(spark, ["a<b>&\x01" + "z" * 300], text.sanitize_label("x")) == ["a&lt;b&gt;&amp;" + "z" * 300]
    assert one(spark, ["Markdown ", None, "weird", "NOTE"], text.file_type("x")) == ["document", "concept", "concept", "rationale"]
    assert one(spark, ["how does main use helper"], F.array_join(text.question_tokens("x"), " ")) == ["main use helper"]
    assert one(spark, ["0.876", "x", None, "7", "-1"], F.bround(text.clamp_score("x"), 2)) == [0.88, 0.75, 0.75, 1.0, 0.0]


def test_paths(spark):
    values = ["a/b.tar.gz", ".env", "x.", "dir/", "noext", "a/.hidden.py"]
    assert one(spark, values, paths.suffix("x")) == [".gz", "", "", "", "", ".py"]
    assert one(spark, values, paths.stem("x")) == ["b.tar", ".env", "x.", "dir", "noext", ".hidden"]


@pytest.mark.parametrize("glob,name,hit", [("*.py", "a/b.py", True), ("a?c", "abc", True), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("a.b", "axb", False), ("[", "[", True)])
def test_glob(spark, glob, name, hit):
    assert spark.range(1).select(F.lit(name).rlike(paths.glob_regex(glob))).first()[0] is hit


def test_secrets(spark):
    bad = [".env", "server.pem", ".ssh/id_rsa", "secrets/api_key.json", "api_token.txt", "creds.json", ".env.local", "my-password"]
    good = ["tokenizer.py", "docs/token-economics-of-recall.md", "a/secretary.py", "src/app.py"]
    assert one(spark, bad, classify.is_sensitive("x")) == [True] * len(bad)
    assert one(spark, good, classify.is_sensitive("x")) == [False] * len(good)


def test_classes(spark):
    names = ["a.py", "a.ts", "a.go", "a.rs", "a.md", "a.pdf", "a.PNG", "a.xyz", "Makefile", ".gitignore"]
    want = ["code", "code", "code", "code", "document", "paper", "image", None, None, None]
    assert one(spark, names, classify.classify("x", F.lit("text"))) == want
    paper = "Abstract\nThis arXiv preprint shows [1] and [2]."
    assert one(spark, [paper, "plain"], classify.classify(F.lit("p.md"), "x")) == ["paper", "document"]
    late = "x" * 3000 + paper
    assert one(spark, [late], classify.classify(F.lit("p.md"), "x")) == ["paper"]


def test_ignore_rules(spark):
    rules = ["generated/", "*.log", "!keep.log", "a/*/z"]
    files = ["generated/x.py", "src/generated/y.py", "b.log", "d/keep.log", "a/q/z", "src/app.py"]
    assert one(spark, files, classify.ignored("x", rules)) == [True, True, True, False, True, False]
    lines = ["# c", "", "  *.tmp  ", "a b # note", r"\#x"]
    assert one(spark, lines, classify.parse_ignore_line("x")) == ["", "", "*.tmp", "a b", "#x"]


def test_jaro_winkler_known_values():
    assert round(jaro_winkler_pair("martha", "marhta"), 4) == 0.9611
    assert round(jaro_winkler_pair("dixon", "dicksonx"), 4) == 0.8133
    assert round(jaro_winkler_pair("notes md", "notes"), 4) == 0.925
    assert jaro_winkler_pair("", "a") == 0.0 and jaro_winkler_pair("ab", "ab") == 1.0


@given(st.text("abcd ", max_size=14), st.text("abcd ", max_size=14))
def test_jaro_winkler_properties(a, b):
    import duckdb

    mine = jaro_winkler_pair(a, b)
    assert 0.0 <= mine <= 1.0
    if a and b:
        other = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert abs(mine - other) < 1e-9


def test_prices(spark):
    prices = ledger.price_list('{"gpt-4o": [1.0, 2.0], "house": [5, 5]}')
    assert prices[3] == ("gpt-4o", 1.0, 2.0) and prices[-1] == ("house", 5.0, 5.0)
    assert ledger.price_list("not json") == list(fixed.PRICES)
    rows = spark.createDataFrame([("gpt-4o-x", 1_000_000, 1_000_000), ("unknown", 5, 5), ("deepseek-v3", 123, 457)], "m string, p long, c long")
    got = [r[0] for r in rows.select(ledger.estimate_cost(F.col("m"), F.col("p"), F.col("c"), prices)).collect()]
    assert got == [3.0, 0.0, round(123 / 1e6 * 0.27 + 457 / 1e6 * 1.10, 6)]


def test_urls_that_cannot_be_read_are_invalid(spark):
    cases = [
        ("http://a.org/x", True, "a.org"), ("HTTPS://a.org", True, "a.org"), ("ftp://a.org/x", False, "a.org"), ("file:///etc/passwd", False, None),
        ("http://a b/ c", False, None), ("http://", False, None), ("no scheme", False, None), ("", False, None), (None, False, None),
    ]
    df = spark.createDataFrame([(u,) for u, _, _ in cases], "url string")
    got = df.select("url", urls.valid_url(F.col("url")).alias("valid"), urls.url_host(F.col("url")).alias("host")).collect()
    assert [tuple(r) for r in got] == cases


def test_short_cuts_of_keys_change_nothing(spark):
    words = [" x ", ".Foo()", "a b\t", "\u00a0Foo()", "Foo()\n", "()", "", "f()()", "\u3000x", "~", "a(b)", "\x1fy", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(
        text.callable_key("w").alias("key"),
        F.lower(F.ltrim(F.btrim(F.regexp_replace("w", rf"(?U)^{text._SPACE}+|{text._SPACE}+$", ""), F.lit("()")), F.lit("."))).alias("plain_key"),
        text.strip_call(F.col("w")).alias("bare"),
        F.regexp_replace("w", r"\(\)$", "").alias("plain_bare"),
    )
    assert all(r.key == r.plain_key and r.bare == r.plain_bare for r in rows.collect())


def test_results_are_handed_on_before_a_batch_is_through():
    import pyarrow as pa

    from loomgraph.functions import slices
    from loomgraph.operators import extract_code, extract_manifest

    body = "\n".join(f"import m_{i}" for i in range(3000))
    files = pa.RecordBatch.from_pylist([{"path": f"f{i}.py", "language": "python", "file_id": f"f{i}", "content": body} for i in range(40)])
    out = list(extract_code._scan(iter([files])))
    assert [p for b in out for p in b["path"].to_pylist()] == [f"f{i}.py" for i in range(40)]
    assert all(len(x) == 3000 for b in out for x in b["facts"].to_pylist())
    assert max(sum(len(x) + 1 for x in b["facts"].to_pylist()) for b in out) < slices.HELD + 3001
    listed = '[project]\nname = "p"\ndependencies = [' + ", ".join(f'"d{i}>=1"' for i in range(9000)) + "]\n"
    rows = pa.RecordBatch.from_pylist([{"path": f"{i}/pyproject.toml", "content": listed} for i in range(7)] + [{"path": "none", "content": None}])
    out = list(extract_manifest._pyprojects(iter([rows])))
    assert [b.num_rows for b in out] == [3, 3, 2] and out[-1].to_pylist()[-1] == {"path": "none", "package": None, "deps": []}
