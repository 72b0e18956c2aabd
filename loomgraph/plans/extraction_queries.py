"""Queries over extractors: markdown from pages, code from documents, manifests from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import extract_code, extract_manifest, extract_markdown
from loomgraph.plans.registry import query
from loomgraph.plans.text_queries import _normalize_sql
from loomgraph.sources.tables import page_markdown, page_markdown_sql, source_files, table

# --- markdown -------------------------------------------------------------------

_HEADING = "^(#{1,6})\\s+(.+?)\\s*#*\\s*$"
_TITLE = f"trim(regexp_extract(line, '{_HEADING}', 2))"
_HEADINGS_SQL = f"""{page_markdown_sql()},
lines AS (SELECT page_id, path, generate_subscripts(string_split(content, chr(10)), 1) AS n, unnest(string_split(content, chr(10))) AS line FROM md),
heads AS (SELECT page_id, path, n, length(regexp_extract(line, '{_HEADING}', 1)) AS level, {_TITLE} AS title,
          {_normalize_sql("'p_' || page_id || '_' || trim(" + _TITLE + ", '_.')")} AS id,
          'p_' || page_id || '_md' AS file_id FROM lines WHERE regexp_matches(line, '{_HEADING}') AND {_TITLE} <> ''),
near AS (SELECT h.path, h.n, arg_max(k.id, k.n) AS id, arg_max(k.level, k.n) AS level FROM heads h JOIN heads k ON h.path = k.path AND k.n < h.n AND k.level < h.level
         GROUP BY h.path, h.n),
placed AS (SELECT h.*, CASE WHEN near.level = h.level - 1 THEN near.id
           WHEN h.level > coalesce(lag(h.level) OVER (PARTITION BY h.path ORDER BY h.n), 0)
           THEN coalesce(lag(h.id) OVER (PARTITION BY h.path ORDER BY h.n), h.file_id) END AS parent
           FROM heads h LEFT JOIN near ON h.path = near.path AND h.n = near.n),
l1 AS (SELECT path, generate_subscripts(ts, 1) AS seq, unnest(ts) AS t
       FROM (SELECT path, regexp_extract_all(content, '\\[([^\\]]+)\\]\\(([^)]+)\\)', 2) AS ts FROM md)),
inl AS (SELECT path, seq, regexp_replace(rtrim(split_part(split_part(trim(t), '#', 1), '?', 1), '/'), '^.*/', '') AS name FROM l1
        WHERE NOT regexp_matches(trim(t), '^(https?://|mailto:)') AND split_part(split_part(trim(t), '#', 1), '?', 1) <> ''),
wiki AS (SELECT path, 1000000000 + generate_subscripts(ws, 1) AS seq, trim(split_part(unnest(ws), '|', 1)) AS name
         FROM (SELECT path, regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1) AS ws FROM md)),
refs AS (SELECT path, seq, name, {_normalize_sql("trim(name, '_.')")} AS id FROM (SELECT * FROM inl UNION ALL SELECT * FROM wiki WHERE name <> ''))"""


@query("markdown_headings", f"WITH {_HEADINGS_SQL} SELECT path, CAST(n AS INTEGER) AS line, CAST(level AS INTEGER) AS level, title, id, parent FROM placed")
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_markdown.headings(page_markdown(spark, sf_dir))


@query("markdown_links", f"WITH {_HEADINGS_SQL} SELECT path, name FROM refs")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_markdown.links(page_markdown(spark, sf_dir)).select("path", "name")


@query(
    "markdown_edges",
    f"""WITH {_HEADINGS_SQL}
    SELECT path AS source_file, file_id AS source, id AS target, 'contains' AS relation, 'L' || n AS source_location FROM placed
    UNION ALL SELECT path, parent, id, 'contains', 'L' || n FROM placed WHERE parent <> id
    UNION ALL SELECT path, replace(regexp_replace(path, '^.*/', ''), '.', '_'), id, 'references', NULL FROM refs""",
)
def markdown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = extract_markdown.extract_markdown(page_markdown(spark, sf_dir))
    return edges.select("source_file", "source", "target", "relation", "source_location")


@query(
    "markdown_nodes",
    f"""WITH {_HEADINGS_SQL}
    SELECT path AS source_file, 'p_' || page_id || '_md' AS id, 'p_' || page_id || '.md' AS label, 'L1' AS source_location FROM md
    UNION ALL SELECT path, id, arg_min(title, n), 'L' || min(n) FROM heads GROUP BY path, id
    UNION ALL SELECT path, id, arg_min(name, seq), NULL FROM refs r WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.path = r.path AND h.id = r.id) GROUP BY path, id""",
)
def markdown_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = extract_markdown.extract_markdown(page_markdown(spark, sf_dir))
    return nodes.select("source_file", "id", "label", "source_location")


# --- code ------------------------------------------------------------------------

_BLOCKS_SQL = """blocks AS (
  SELECT source || '/d' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'js' WHEN 'fr' THEN 'go' ELSE 'rs' END AS path,
         'd' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'js' WHEN 'fr' THEN 'go' ELSE 'rs' END AS name,
         source || '_d' || doc_id AS file_id, lang, w[1] AS a, w[2] AS b, w[3] AS c,
         (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1) * CASE lang WHEN 'en' THEN 4 ELSE 6 END AS base,
         CASE WHEN lang IN ('en', 'de') THEN 3 ELSE 4 END AS fn
  FROM (SELECT doc_id, source, lang, n, regexp_extract_all(line, '[a-z]{3,}') AS w FROM (
          SELECT doc_id, source, lang, generate_subscripts(string_split(lower(text), chr(10)), 1) AS n,
                 unnest(string_split(lower(text), chr(10))) AS line FROM documents)) WHERE len(w) >= 3)"""
_CODE_FILES_SQL = """code_files AS (SELECT source || '/d' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'js' WHEN 'fr' THEN 'go' ELSE 'rs' END AS path,
  'd' || doc_id || '.' || CASE lang WHEN 'en' THEN 'py' WHEN 'de' THEN 'js' WHEN 'fr' THEN 'go' ELSE 'rs' END AS name, source || '_d' || doc_id AS file_id FROM documents)"""


@query(
    "code_edges",
    f"""WITH {_BLOCKS_SQL}
    SELECT path AS source_file, file_id AS source, 'mod_m_' || a AS target, 'imports' AS relation, 'L' || (base + 1) AS source_location FROM blocks
    UNION ALL SELECT path, file_id, 'c_' || b, 'contains', 'L' || (base + 2) FROM blocks
    UNION ALL SELECT path, 'c_' || b, 'b_' || c, 'inherits', 'L' || (base + 2) FROM blocks WHERE lang <> 'fr'
    UNION ALL SELECT path, file_id, 'f_' || a, 'contains', 'L' || (base + fn) FROM blocks
    UNION ALL SELECT path, 'r_' || c, 'f_' || a, 'method', 'L' || (base + fn) FROM blocks WHERE lang = 'fr'""",
)
def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = extract_code.extract_code(source_files(spark, sf_dir))["edges"]
    return edges.select("source_file", "source", "target", "relation", "source_location")


@query(
    "code_nodes",
    f"""WITH {_BLOCKS_SQL}, {_CODE_FILES_SQL}
    SELECT path AS source_file, file_id AS id, name AS label, 'L1' AS source_location, NULL AS kind FROM code_files
    UNION ALL SELECT path, 'mod_m_' || a, 'm_' || a, NULL, NULL FROM blocks GROUP BY path, a
    UNION ALL SELECT path, 'c_' || b, 'C_' || b, 'L' || min(base + 2), CASE lang WHEN 'fr' THEN 'type' WHEN 'es' THEN 'trait' ELSE 'class' END FROM blocks GROUP BY path, lang, b
    UNION ALL SELECT path, 'f_' || a, 'f_' || a || '()', 'L' || min(base + fn), 'function' FROM blocks GROUP BY path, a
    UNION ALL SELECT path, CASE lang WHEN 'fr' THEN 'r_' ELSE 'b_' END || c, CASE lang WHEN 'fr' THEN 'R ' ELSE 'B ' END || upper(c[1]) || c[2:], NULL, NULL
      FROM blocks GROUP BY path, lang, c""",
)
def code_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = extract_code.extract_code(source_files(spark, sf_dir))["nodes"]
    return nodes.select("source_file", "id", "label", "source_location", "kind")


@query(
    "code_calls",
    f"""WITH {_BLOCKS_SQL} SELECT file_id AS caller, 'f_' || b AS name, 'L' || (base + fn + 1) AS location, path AS source_file FROM blocks""",
)
def code_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = extract_code.extract_code(source_files(spark, sf_dir))["calls"]
    return calls.select("caller", "name", "location", "source_file")


@query(
    "code_definitions",
    f"""WITH {_BLOCKS_SQL} SELECT path AS fragment_key, 'c_' || b AS label, 'c_' || b AS node_id FROM blocks
    UNION ALL SELECT path, 'f_' || a, 'f_' || a FROM blocks""",
)
def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_code.extract_code(source_files(spark, sf_dir))["definitions"]
    return found.select("fragment_key", "label", "node_id")


# --- manifests -------------------------------------------------------------------------


def manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as packages that depend on the brands they deliver; the format follows the nation."""
    li, p, s = (table(spark, sf_dir, x) for x in ("lineitem", "part", "supplier"))
    brands = (
        li.join(p.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey")
        .groupBy("l_suppkey")
        .agg(F.array_sort(F.collect_set(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("-"), F.lower("p_type")))).alias("deps"))
    )
    rows = s.join(brands.withColumnRenamed("l_suppkey", "s_suppkey"), "s_suppkey")
    name = F.concat(F.lit("pkg-"), "s_suppkey")
    npm = F.to_json(F.struct(name.alias("name"), F.map_from_arrays("deps", F.transform("deps", lambda _: F.lit("1.0"))).alias("dependencies")))
    toml = F.concat(F.lit('[project]\nname = "'), name, F.lit('"\ndependencies = ["'), F.array_join("deps", '>=1", "'), F.lit('>=1"]\n'))
    gomod = F.concat(F.lit("module "), name, F.lit("\n\nrequire (\n\t"), F.array_join("deps", " v1.0\n\t"), F.lit(" v1.0\n)\n"))
    pick = F.col("s_nationkey") % 3
    folder = F.concat(F.lit("s"), "s_suppkey", F.lit("/"))
    return rows.select(
        F.concat(folder, F.when(pick == 0, "package.json").when(pick == 1, "pyproject.toml").otherwise("go.mod")).alias("path"),
        F.when(pick == 0, npm).when(pick == 1, toml).otherwise(gomod).alias("content"),
    )


_MANIFEST_SQL = """deps AS (SELECT DISTINCT l_suppkey, lower(replace(p_brand, '#', '-')) || '-' || lower(p_type) AS dep FROM lineitem JOIN part ON l_partkey = p_partkey),
ranked AS (SELECT l_suppkey, dep, row_number() OVER (PARTITION BY l_suppkey ORDER BY dep) AS n FROM deps),
m AS (SELECT s_suppkey, 'manifest:s' || s_suppkey || '/' || f AS fragment_key, replace(f, '.', '_') AS file_id, 'pkg_pkg_' || s_suppkey AS package_id FROM
      (SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'package.json' WHEN 1 THEN 'pyproject.toml' ELSE 'go.mod' END AS f FROM supplier
       WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)))"""


@query(
    "manifest_edges",
    f"""WITH {_MANIFEST_SQL} SELECT fragment_key, file_id AS source, package_id AS target, 'defines_package' AS relation FROM m
    UNION ALL SELECT fragment_key, package_id, 'pkg_' || replace(dep, '-', '_'), 'depends_on' FROM m JOIN ranked ON s_suppkey = l_suppkey""",
)
def manifest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = extract_manifest.extract_manifests(manifest_sources(spark, sf_dir))
    return edges.select("fragment_key", "source", "target", "relation")


@query(
    "manifest_nodes",
    f"""WITH {_MANIFEST_SQL} SELECT fragment_key, file_id AS id, regexp_replace(fragment_key, '^.*/', '') AS label, 'L1' AS source_location FROM m
    UNION ALL SELECT fragment_key, package_id, 'pkg-' || s_suppkey, 'L1' FROM m
    UNION ALL SELECT fragment_key, 'pkg_' || replace(dep, '-', '_'), dep, NULL FROM m JOIN ranked ON s_suppkey = l_suppkey""",
)
def manifest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = extract_manifest.extract_manifests(manifest_sources(spark, sf_dir))
    return nodes.select("fragment_key", "id", "label", "source_location")
