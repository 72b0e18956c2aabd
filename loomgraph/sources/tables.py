"""Graph inputs derived from the star-schema tables.

Nothing is generated: every node, edge, file, fragment and ledger row below is
a projection, join or distinct of the given parquet tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.assemble import pair_keys
from loomgraph.session import dealt, spread

KIND_STRIDE = 1_000_000_000_000  # keeps the node order of one table apart from the next


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts, with enough tasks for work on every text."""
    return spread(table(spark, sf_dir, name))


def _node(kind: str, rank: int, key: str, label: Column, file_type: str, source_file: str) -> list[Column]:
    return [
        _id(kind, key).alias("id"),
        label.alias("label"),
        F.lit(file_type).alias("file_type"),
        F.lit(source_file).alias("source_file"),
        F.concat(F.lit("L"), F.col(key) + 1).alias("source_location"),
        (F.lit(rank * KIND_STRIDE) + F.col(key)).cast("long").alias("ord"),
        F.lower(label).alias("norm_label"),
    ]


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def t(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    parts = [
        t("region").select(_node("region", 0, "r_regionkey", F.col("r_name"), "document", "geo/region.md")),
        t("nation").select(_node("nation", 1, "n_nationkey", F.col("n_name"), "document", "geo/nation.md")),
        t("customer").select(_node("customer", 2, "c_custkey", F.col("c_name"), "document", "trade/customer.py")),
        t("supplier").select(_node("supplier", 3, "s_suppkey", F.col("s_name"), "code", "trade/supplier.go")),
        t("part").select(_node("part", 4, "p_partkey", F.col("p_name"), "code", "trade/part.py")),
        t("orders").select(
            _node("order", 5, "o_orderkey", F.concat(F.lit("order_"), F.col("o_orderkey"), F.lit("()")), "code", "trade/orders.py")
        ),
    ]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionAll(p)
    return nodes


def _edge(source: Column, target: Column, relation: str, source_file: str, confidence: Column | None = None, score: float | None = None) -> list[Column]:
    return [
        source.alias("source"),
        target.alias("target"),
        F.lit(relation).alias("relation"),
        (confidence if confidence is not None else F.lit("EXTRACTED")).alias("confidence"),
        F.lit(score).cast("double").alias("confidence_score"),
        F.lit(source_file).alias("source_file"),
        F.lit(None).cast("string").alias("source_location"),
        F.lit(1.0 if score is None else score).alias("weight"),
    ]


def _id(kind: str, key: str) -> Column:
    """What ``ids.make_id`` makes of a word and a number, without normalising every id."""
    return F.concat(F.lit(f"{kind}_"), F.col(key))


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region - nation - customer / supplier."""
    n, c, s = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier"))
    rn = n.select(_edge(_id("region", "n_regionkey"), _id("nation", "n_nationkey"), "contains", "geo/nation.md"))
    nc = c.select(_edge(_id("nation", "c_nationkey"), _id("customer", "c_custkey"), "contains", "trade/customer.py"))
    ns = s.select(_edge(_id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "contains", "trade/supplier.go"))
    return rn.unionAll(nc).unionAll(ns)


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geography plus customer - order - part - supplier; one edge per pair."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    co = o.select(_edge(_id("customer", "o_custkey"), _id("order", "o_orderkey"), "references", "trade/orders.py"))
    rows = li.count()  # from the footers
    op = dealt(li.select("l_orderkey", "l_partkey", "l_discount"), rows, "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.max("l_discount").alias("d"))
    doubt = F.when(F.col("d") > 0.09, "AMBIGUOUS").otherwise("EXTRACTED")
    op = op.select(_edge(_id("order", "l_orderkey"), _id("part", "l_partkey"), "depends_on", "trade/lineitem.py", doubt))
    ps = dealt(li.select("l_partkey", "l_suppkey"), rows, "l_partkey", "l_suppkey").distinct()
    ps = ps.select(_edge(_id("part", "l_partkey"), _id("supplier", "l_suppkey"), "calls", "trade/lineitem.py", F.lit("INFERRED"), 0.85))
    edges = geo_edges(spark, sf_dir).unionAll(co).unionAll(op).unionAll(ps)
    k1, k2 = pair_keys()
    return edges.withColumns({"k1": k1, "k2": k2})


def star_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given partition: nations own their customers, suppliers and orders; brands own parts."""
    n, c, s, p, o = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier", "part", "orders"))
    home = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = [
        n.select(_id("nation", "n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("cid")),
        c.select(_id("customer", "c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("cid")),
        s.select(_id("supplier", "s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("cid")),
        home.select(_id("order", "o_orderkey").alias("id"), F.col("c_nationkey").cast("long").alias("cid")),
        p.select(_id("part", "p_partkey").alias("id"), (F.regexp_extract("p_brand", r"(\d+)", 1).cast("long") + 100).alias("cid")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier - customer-nation pairs that traded; weight is the number of line items."""
    o, li, c = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "customer"))
    home = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    pairs = li.join(home.select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey"), "l_orderkey").groupBy("l_suppkey", "c_nationkey")
    edges = pairs.agg(F.count("*").cast("double").alias("weight")).select(
        _id("supplier", "l_suppkey").alias("source"),
        _id("nation", "c_nationkey").alias("target"),
        F.lit("calls").alias("relation"),
        F.lit("EXTRACTED").alias("confidence"),
        F.lit(None).cast("double").alias("confidence_score"),
        F.lit("trade/lineitem.py").alias("source_file"),
        F.lit(None).cast("string").alias("source_location"),
        "weight",
    )
    k1, k2 = pair_keys()
    return edges.withColumns({"k1": k1, "k2": k2})


# --- a file tree over documents -------------------------------------------------

_FOLDERS = {"src0": "secrets", "src1": "node_modules", "src2": "lib_venv", "src3": "docs/generated"}
_NAMES = [
    "api_token", "tokenizer", "id_rsa", "user-password-reset-flow", ".env", "my_secrets",
    "token-economics-of-recall", "notes", "server.pem", "poetry.lock", "readme",
]
_SUFFIX = {"en": ".md", "de": ".txt", "fr": ".py", "es": ".JSON"}


def _case(col: Column, mapping: dict, default: Column) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, v) if expr is None else expr.when(col == k, v)
    return expr.otherwise(default)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: (doc_id, path, content)."""
    d = texts(spark, sf_dir, "documents")
    folder = _case(F.col("source"), _FOLDERS, F.col("source"))
    name = _case(F.col("doc_id") % len(_NAMES), dict(enumerate(_NAMES)), F.lit("notes"))
    ext = F.when(name.isin(".env", "server.pem", "poetry.lock"), "").otherwise(_case(F.col("lang"), _SUFFIX, F.lit("")))
    return d.select(
        "doc_id", F.concat(folder, F.lit("/"), "doc_id", F.lit("/"), name, ext).alias("path"), F.col("text").alias("content")
    )


def _sql_case(col: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN {k!r} THEN '{v}'" if isinstance(k, str) else f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {default} END"


def document_files_sql() -> str:
    """The same projection for the SQL side."""
    name = _sql_case(f"doc_id % {len(_NAMES)}", dict(enumerate(_NAMES)), "'notes'")
    folder = _sql_case("source", _FOLDERS, "source")
    ext = _sql_case("lang", _SUFFIX, "''")
    return (
        f"files AS (SELECT doc_id, content, folder || '/' || doc_id || '/' || name || "
        f"CASE WHEN name IN ('.env', 'server.pem', 'poetry.lock') THEN '' ELSE ext END AS path, name AS base_name, folder "
        f"FROM (SELECT doc_id, text AS content, {folder} AS folder, {name} AS name, {ext} AS ext FROM documents))"
    )


STAR_SQL = """
nodes AS (
  SELECT 'region_' || r_regionkey AS id, r_name AS label, 'document' AS file_type, 'geo/region.md' AS source_file,
         CAST(r_regionkey AS BIGINT) AS ord FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, n_name, 'document', 'geo/nation.md', 1000000000000 + n_nationkey FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, c_name, 'document', 'trade/customer.py', 2000000000000 + c_custkey FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, s_name, 'code', 'trade/supplier.go', 3000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'part_' || p_partkey, p_name, 'code', 'trade/part.py', 4000000000000 + p_partkey FROM part
  UNION ALL SELECT 'order_' || o_orderkey, 'order_' || o_orderkey || '()', 'code', 'trade/orders.py', 5000000000000 + o_orderkey FROM orders
),
geo AS (
  SELECT 'region_' || n_regionkey AS source, 'nation_' || n_nationkey AS target, 'contains' AS relation,
         'EXTRACTED' AS confidence, CAST(NULL AS DOUBLE) AS confidence_score, CAST(1 AS DOUBLE) AS weight FROM nation
  UNION ALL SELECT 'nation_' || c_nationkey, 'customer_' || c_custkey, 'contains', 'EXTRACTED', NULL, 1 FROM customer
  UNION ALL SELECT 'nation_' || s_nationkey, 'supplier_' || s_suppkey, 'contains', 'EXTRACTED', NULL, 1 FROM supplier
),
edges AS (
  SELECT * FROM geo
  UNION ALL SELECT 'customer_' || o_custkey, 'order_' || o_orderkey, 'references', 'EXTRACTED', NULL, 1 FROM orders
  UNION ALL SELECT 'order_' || l_orderkey, 'part_' || l_partkey, 'depends_on',
         CASE WHEN max(l_discount) > 0.09 THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END, NULL, 1
         FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT DISTINCT 'part_' || l_partkey, 'supplier_' || l_suppkey, 'calls', 'INFERRED', 0.85, 0.85 FROM lineitem
),
sym AS (
  SELECT source AS id, target AS other, relation, confidence, TRUE AS forward FROM edges
  UNION ALL SELECT target, source, relation, confidence, FALSE FROM edges WHERE source <> target
),
deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
membership AS (
  SELECT 'nation_' || n_nationkey AS id, CAST(n_nationkey AS BIGINT) AS cid FROM nation
  UNION ALL SELECT 'customer_' || c_custkey, c_nationkey FROM customer
  UNION ALL SELECT 'supplier_' || s_suppkey, s_nationkey FROM supplier
  UNION ALL SELECT 'order_' || o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 'part_' || p_partkey, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) + 100 FROM part
)
"""

TRADE_SQL = """
trade AS (
  SELECT 'supplier_' || l_suppkey AS source, 'nation_' || c_nationkey AS target, CAST(count(*) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY l_suppkey, c_nationkey
)
"""


# --- fragments: orders as files, their lines as node and edge records ---------------


def _line_keys() -> list[Column]:
    pos = F.col("l_linenumber").cast("long") * KIND_STRIDE + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    return [F.format_string("order/%012d", F.col("l_orderkey")).alias("fragment_key"), pos.alias("pos")]


LINE_KEYS_SQL = (
    "printf('order/%012d', l_orderkey) AS fragment_key, "
    "CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos"
)


def supplier_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item mentions its supplier; some mentions carry a place or a kind."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("supplier_"), "l_suppkey").alias("id"),
        F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(F.lit("s"), "l_suppkey", F.lit(" "), "l_returnflag")).alias("label"),
        F.when(F.col("l_tax") > 0.06, "tool").when(F.col("l_tax") > 0.03, " Note").otherwise("document").alias("file_type"),
        F.concat(F.lit("orders/"), "l_orderkey").alias("source_file"),
        F.when((F.col("l_discount") > 0.09) & (F.col("l_quantity") > 48), F.concat(F.lit("L"), "l_linenumber")).alias("source_location"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 49), F.concat(F.lit("k"), "l_returnflag", "l_linenumber")).alias("kind"),
        F.when(F.col("l_quantity") < 2, F.concat(F.lit("sum "), "l_orderkey")).alias("summary"),
        *_line_keys(),
    )


SUPPLIER_RECORDS_SQL = f"""records AS (SELECT 'supplier_' || l_suppkey AS id,
  CASE WHEN l_linenumber = 7 THEN '' ELSE 's' || l_suppkey || ' ' || l_returnflag END AS label,
  CASE WHEN l_tax > 0.06 THEN 'code' WHEN l_tax > 0.03 THEN 'rationale' ELSE 'document' END AS file_type,
  'orders/' || l_orderkey AS source_file,
  CASE WHEN l_discount > 0.09 AND l_quantity > 48 THEN 'L' || l_linenumber END AS source_location,
  CASE WHEN l_linestatus = 'F' AND l_quantity > 49 THEN 'k' || l_returnflag || l_linenumber END AS kind,
  CASE WHEN l_quantity < 2 THEN 'sum ' || l_orderkey END AS summary, {LINE_KEYS_SQL} FROM lineitem)"""


def trade_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item states one edge between its supplier and the customer's nation."""
    o, li, c = (table(spark, sf_dir, x) for x in ("orders", "lineitem", "customer"))
    home = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = li.join(home.select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey"), "l_orderkey")
    a, b = F.concat(F.lit("supplier_"), "l_suppkey"), F.concat(F.lit("nation_"), "c_nationkey")
    flip = F.col("l_linenumber") % 2 == 1
    confidence = F.when(F.col("l_discount") > 0.09, "AMBIGUOUS").when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), "EXTRACTED").otherwise("INFERRED")
    return rows.select(
        F.when(flip, b).otherwise(a).alias("source"),
        F.when(flip, a).otherwise(b).alias("target"),
        F.when(F.col("l_returnflag") == "A", "calls").when(F.col("l_returnflag") == "N", "references").otherwise("imports").alias("relation"),
        confidence.alias("confidence"),
        F.when(confidence == "INFERRED", F.col("l_discount")).alias("confidence_score"),
        F.concat(F.lit("orders/"), "l_orderkey").alias("source_file"),
        F.concat(F.lit("L"), "l_linenumber").alias("source_location"),
        F.col("l_quantity").alias("weight"),
        *_line_keys(),
    )


TRADE_RECORDS_SQL = f"""records AS (SELECT
  CASE WHEN l_linenumber % 2 = 1 THEN 'nation_' || c_nationkey ELSE 'supplier_' || l_suppkey END AS source,
  CASE WHEN l_linenumber % 2 = 1 THEN 'supplier_' || l_suppkey ELSE 'nation_' || c_nationkey END AS target,
  CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'references' ELSE 'imports' END AS relation,
  CASE WHEN l_discount > 0.09 THEN 'AMBIGUOUS' WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence,
  CASE WHEN l_discount > 0.09 OR (l_linestatus = 'F' AND l_quantity > 45) THEN NULL ELSE l_discount END AS confidence_score,
  'orders/' || l_orderkey AS source_file, 'L' || l_linenumber AS source_location, l_quantity AS weight, {LINE_KEYS_SQL}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def order_fragments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as fragments with flaws: (nodes, edges).

    The order is a node, each line's part is a node unless the line is a
    return of more than 45 pieces, and every line is an edge order -> part.
    """
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.format_string("order/%012d", F.col("o_orderkey"))
    own = o.select(
        F.concat(F.lit("order_"), "o_orderkey").alias("id"),
        F.when(F.col("o_totalprice") > 5000, F.concat(F.lit("order "), "o_orderkey")).alias("label"),
        F.when(F.col("o_totalprice") > 495000, "invoice").otherwise("code").alias("file_type"),
        F.lit("orders.py").alias("source_file"),
        key.alias("fragment_key"),
        F.lit(0).cast("long").alias("pos"),
    )
    parts = li.where(~((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))).select(
        F.concat(F.lit("part_"), "l_partkey").alias("id"),
        F.concat(F.lit("part "), "l_partkey").alias("label"),
        F.lit("code").alias("file_type"),
        F.lit("orders.py").alias("source_file"),
        *_line_keys(),
    )
    edges = li.select(
        F.concat(F.lit("order_"), "l_orderkey").alias("source"),
        F.concat(F.lit("part_"), "l_partkey").alias("target"),
        F.when(F.col("l_tax") < 0.08, "depends_on").alias("relation"),
        F.when(F.col("l_discount") > 0.0999, "MAYBE").otherwise("EXTRACTED").alias("confidence"),
        F.lit("orders.py").alias("source_file"),
        *_line_keys(),
    )
    return own.unionAll(parts), edges


ORDER_FRAGMENTS_SQL = f"""fnodes AS (SELECT 'order_' || o_orderkey AS id, CASE WHEN o_totalprice > 5000 THEN 'order ' || o_orderkey END AS label,
    CASE WHEN o_totalprice > 495000 THEN 'invoice' ELSE 'code' END AS file_type, printf('order/%012d', o_orderkey) AS fragment_key, 0 AS pos FROM orders
  UNION ALL SELECT 'part_' || l_partkey, 'part ' || l_partkey, 'code', {LINE_KEYS_SQL} FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity > 45)),
fedges AS (SELECT 'order_' || l_orderkey AS source, 'part_' || l_partkey AS target, CASE WHEN l_tax < 0.08 THEN 'depends_on' END AS relation,
    CASE WHEN l_discount > 0.0999 THEN 'MAYBE' ELSE 'EXTRACTED' END AS confidence, {LINE_KEYS_SQL} FROM lineitem)"""


# --- texts as sources: every line of a document becomes a few declarations -------------

_TEMPLATES = {
    "en": ("py", "import m_{0}\nclass C_{1}(B_{2}):\n    def f_{0}(self):\n        return f_{1}(self.x)\n"),
    "de": ("js", "import x from 'm_{0}';\nclass C_{1} extends B_{2} {{\n  f_{0}(x) {{\n    return f_{1}(x);\n  }}\n}}\n"),
    "fr": ("go", "import \"m_{0}\"\ntype C_{1} struct {{\n}}\nfunc (s *R_{2}) f_{0}(x int) int {{\n    return f_{1}(x)\n}}\n"),
    "es": ("rs", "use m_{0};\ntrait C_{1}: B_{2} {{\n}}\nfn f_{0}(x: u8) -> u8 {{\n    f_{1}(x)\n}}\n"),
}


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source code: (path, content), one block per line with three words."""
    d = texts(spark, sf_dir, "documents")
    lines = F.filter(
        F.transform(F.split(F.lower("text"), "\n"), lambda line: F.regexp_extract_all(line, F.lit("[a-z]{3,}"), F.lit(0))),
        lambda words: F.size(words) >= 3,
    )
    body = None
    for lang, (_, template) in _TEMPLATES.items():
        text_of = F.array_join(F.transform(lines, _block(template)), "")
        body = F.when(F.col("lang") == lang, text_of) if body is None else body.when(F.col("lang") == lang, text_of)
    ext = _case(F.col("lang"), {k: v[0] for k, v in _TEMPLATES.items()}, F.lit("txt"))
    return d.select(F.concat("source", F.lit("/d"), "doc_id", F.lit("."), ext).alias("path"), body.alias("content"))


def _block(template: str):
    """The template with its numbered slots filled from a line's first words."""
    pieces = re.split(r"\{(\d)\}", template)
    texts = [t.replace("{{", "{").replace("}}", "}") for t in pieces[::2]]
    slots = [int(i) for i in pieces[1::2]]

    def fill(words: Column) -> Column:
        out = [F.lit(texts[0])]
        for slot, tail in zip(slots, texts[1:]):
            out += [words[slot], F.lit(tail)]
        return F.concat(*out)

    return fill


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as markdown: (path, content); titles, headings and links keep their role."""
    body = F.col("html")
    for pattern, markdown in PAGE_RULES:
        body = F.regexp_replace(body, pattern, markdown)
    return texts(spark, sf_dir, "pages").select(F.concat(F.lit("pages/p_"), "page_id", F.lit(".md")).alias("path"), body.alias("content"))


PAGE_RULES = [
    ("<title>", "\n# "),
    ("<h1>", "\n### "),
    ("<p><b>", "\n## "),
    ("</title>|</h1>|<br>|</p>", "\n"),
    ("<a href=\"([^\"]*)\">", "[[wiki|x]] [to]($1.md?v=1#top) [out](https://example.com/$1) "),
]


def page_markdown_sql() -> str:
    body = "html"
    for pattern, markdown in PAGE_RULES:
        escaped = markdown.replace("$1", "\\1").replace("\n", "' || chr(10) || '")
        body = f"regexp_replace({body}, '{pattern}', '{escaped}', 'g')"
    return f"md AS (SELECT page_id, 'pages/p_' || page_id || '.md' AS path, {body} AS content FROM pages)"
