"""Queries over texts, paths and files: identity, normal forms, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import fixed, ids, paths, text, urls
from loomgraph.functions.similarity import jaro_winkler
from loomgraph.operators import classify
from loomgraph.plans.registry import query
from loomgraph.sources.tables import STAR_SQL, document_files, document_files_sql, star_nodes, table, texts

FILES_SQL = document_files_sql()


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _normalize_sql(col: str) -> str:
    words = f"regexp_replace(nfc_normalize({col}), '([^\\p{{L}}\\p{{N}}_]|_)+', '_', 'g')"
    return f"replace(lower(trim({words}, '_')), 'ß', 'ss')"


# --- identity -----------------------------------------------------------------


@query("normalize_ids", f"SELECT doc_id, {_normalize_sql('text')} AS norm FROM documents")
def normalize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", ids.normalize_id("text").alias("norm"))


_PARENT = "list_filter(string_split(path, '/'), lambda x: x <> '')[-2]"
_BASE = "regexp_replace(path, '^.*/', '')"
_SUFFIX_RAW = "regexp_extract({0}, '^.+(\\.[^.]+)$', 1)"


@query(
    "entity_ids",
    f"""WITH {FILES_SQL}, p AS (SELECT doc_id, path, {_PARENT} AS parent, {_BASE} AS base FROM files),
    q AS (SELECT *, left(base, length(base) - length({_SUFFIX_RAW.format('base')})) AS stem FROM p)
    SELECT doc_id, {_normalize_sql("trim(parent, '_.') || '_' || trim(stem, '_.')")} AS code_file,
    {_normalize_sql("trim(base, '_.')")} AS document_file, {_normalize_sql("'mod_' || trim(path, '_.')")} AS module,
    {_normalize_sql("'pkg_' || trim(stem, '_.')")} AS package, {_normalize_sql("'concept_' || trim(base, '_.')")} AS concept FROM q""",
)
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    return files.select(
        "doc_id",
        ids.code_file_id("path").alias("code_file"),
        ids.document_id("path").alias("document_file"),
        ids.module_id("path").alias("module"),
        ids.package_id(paths.stem("path")).alias("package"),
        ids.concept_id(paths.basename("path")).alias("concept"),
    )


@query(
    "fragment_ids",
    f"WITH {FILES_SQL} SELECT doc_id, {_BASE} || ':' || left(sha256(content), 16) AS fragment_id, sha256(content) AS hash FROM files",
)
def fragment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    return files.select("doc_id", ids.fragment_id(paths.basename("path"), "content").alias("fragment_id"), F.sha2("content", 256).alias("hash"))


@query(
    "module_stems",
    "SELECT page_id, list_filter(string_split(regexp_extract(url, '://([^/]+)', 1), '.'), lambda x: TRUE)[-1] AS stem FROM pages",
)
def module_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ids.module_stem(urls.url_host(F.col("url"))).alias("stem"))


@query(
    "path_parts",
    f"""WITH p AS (SELECT page_id, url, rtrim(url, '/') AS path FROM pages),
    q AS (SELECT page_id, {_BASE} AS base, list_filter(string_split(url, '/'), lambda x: x <> '') AS parts FROM p)
    SELECT page_id, base, {_SUFFIX_RAW.format('base')} AS suffix,
    left(base, length(base) - length({_SUFFIX_RAW.format('base')})) AS stem, parts[-2] AS parent FROM q""",
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id",
        paths.basename("url").alias("base"),
        paths.suffix("url").alias("suffix"),
        paths.stem("url").alias("stem"),
        paths.parent_name("url").alias("parent"),
    )


# --- labels --------------------------------------------------------------------

_DECORATED = "CASE p_size % 4 WHEN 0 THEN '  .' || p_name || '()' WHEN 1 THEN p_name || '()' WHEN 2 THEN '(' || p_name || ') ' ELSE upper(p_name) END"


@query(
    "callable_keys",
    f"SELECT p_partkey, lower(ltrim(trim(trim({_DECORATED}), '()'), '.')) AS key FROM part",
)
def callable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr(_DECORATED)
    return table(spark, sf_dir, "part").select("p_partkey", text.callable_key(label).alias("key"))


@query(
    "lookup_forms",
    f"""SELECT p_partkey, lower(l) AS label, regexp_replace(lower(l), '\\(\\)$', '') AS bare
    FROM (SELECT p_partkey, {_DECORATED} AS l FROM part)""",
)
def lookup_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr(_DECORATED)
    return table(spark, sf_dir, "part").select("p_partkey", text.query_norm(label).alias("label"), text.bare(label).alias("bare"))


@query(
    "sanitize_labels",
    """SELECT page_id, replace(replace(replace(regexp_replace(html, '[\\x00-\\x1f\\x7f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
    AS label FROM pages""",
)
def sanitize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.sanitize_label("html").alias("label"))


@query(
    "sanitize_metadata",
    """SELECT conv_id, turn, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS role,
    replace(replace(replace(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text
    FROM conversations""",
)
def sanitize_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn(
        "meta", text.sanitize_metadata(F.create_map(F.lit("role"), "role", F.lit("text"), "text"))
    )
    return rows.select("conv_id", "turn", F.col("meta")["role"].alias("role"), F.col("meta")["text"].alias("text"))


_RAW_TYPE = (
    "CASE p_size % 9 WHEN 0 THEN ' Markdown' WHEN 1 THEN 'TOOL' WHEN 2 THEN 'note ' WHEN 3 THEN 'Technology' "
    "WHEN 4 THEN 'paper' WHEN 5 THEN NULL WHEN 6 THEN 'image' WHEN 7 THEN '' ELSE p_type END"
)


@query(
    "file_type_synonyms",
    f"""SELECT p_partkey, CASE lower(trim(t)) WHEN 'markdown' THEN 'document' WHEN 'tool' THEN 'code' WHEN 'note' THEN 'rationale'
    WHEN 'technology' THEN 'concept' WHEN 'paper' THEN 'paper' WHEN 'image' THEN 'image' ELSE 'concept' END AS file_type
    FROM (SELECT p_partkey, {_RAW_TYPE} AS t FROM part)""",
)
def file_type_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.file_type(F.expr(_RAW_TYPE)).alias("file_type"))


_TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("title_labels", f"WITH {STAR_SQL} SELECT id, {_TITLE.format('trim(replace(id, chr(95), chr(32)))')} AS label FROM nodes")
def title_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_nodes(spark, sf_dir).select("id", text.title_label("id").alias("label"))


@query(
    "merge_norms",
    """SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM documents""",
)
def merge_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", text.merge_norm("text").alias("norm"))


@query(
    "label_similarity",
    """SELECT p_partkey, round(jaro_winkler_similarity(p_name, lower(p_type)), 9) AS by_type,
    round(jaro_winkler_similarity(p_name, p_brand), 9) AS by_brand, round(jaro_winkler_similarity(p_type, p_brand), 9) AS type_brand FROM part""",
)
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(jaro_winkler("p_name", F.lower("p_type")), 9).alias("by_type"),
        F.round(jaro_winkler("p_name", "p_brand"), 9).alias("by_brand"),
        F.round(jaro_winkler("p_type", "p_brand"), 9).alias("type_brand"),
    )


@query(
    "short_labels",
    "SELECT doc_id, CASE WHEN length(text) > 22 THEN left(text, 21) || '…' ELSE text END AS label, left(text, 400) AS clipped FROM documents",
)
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select(
        "doc_id", text.short_label("text").alias("label"), text.clip_tokens("text", 100).alias("clipped")
    )


@query(
    "question_tokens",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]+'), lambda w: lower(w)),
    lambda w: w NOT IN ({_list(fixed.QUESTION_STOP_WORDS)})), ' ') AS tokens FROM documents""",
)
def question_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", F.array_join(text.question_tokens("text"), " ").alias("tokens"))


_RAW_SCORE = "CASE event_type WHEN 'error' THEN props WHEN 'view' THEN NULL ELSE CAST(value / 100 - 0.1 AS VARCHAR(30)) END"


@query(
    "score_clamp",
    f"""SELECT event_id, least(1.0, greatest(0.0, coalesce(TRY_CAST(s AS DOUBLE), 0.75))) AS score
    FROM (SELECT event_id, {_RAW_SCORE} AS s FROM events)""",
)
def score_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_RAW_SCORE.replace("VARCHAR(30)", "STRING"))
    return table(spark, sf_dir, "events").select("event_id", text.clamp_score(raw).alias("score"))


@query(
    "url_check",
    "SELECT page_id, regexp_matches(url, '^https?://[^/?#]') AS valid, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages",
)
def url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.valid_url(F.col("url")).alias("valid"), urls.url_host(F.col("url")).alias("host"))


# --- classification ----------------------------------------------------------------

_SIGNALS = [p.replace("\\b", "\\b") for p in fixed.PAPER_SIGNALS]


def _hits(patterns, col: str) -> str:
    return " + ".join(f"CAST(regexp_matches({col}, '{p}') AS INTEGER)" for p in patterns)


_PAPER_SQL = f"({_hits(_SIGNALS, 'content')})"
_MD_PAPER_SQL = f"({_hits(['(?i)' + p for p in _SIGNALS[:-1]], 'content')})"


@query("paper_signals", f"WITH {FILES_SQL} SELECT doc_id, {_PAPER_SQL} AS signals, {_MD_PAPER_SQL} >= 3 AS markdown_paper FROM files")
def paper_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select(
        "doc_id", classify.paper_signals("content").alias("signals"), classify.markdown_is_paper("content").alias("markdown_paper")
    )


_CLASS_SQL = f"""CASE WHEN lower({_SUFFIX_RAW.format('path')}) IN ('.py', '.json') THEN 'code'
    WHEN lower({_SUFFIX_RAW.format('path')}) IN ('.md', '.txt') THEN CASE WHEN {_PAPER_SQL} >= 3 THEN 'paper' ELSE 'document' END END"""


@query("classify_files", f"WITH {FILES_SQL} SELECT doc_id, path, {_CLASS_SQL} AS file_type FROM files")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("doc_id", "path", classify.classify("path", "content").alias("file_type"))




@query(
    "secret_filter",
    f"""WITH {FILES_SQL} SELECT doc_id, folder = 'secrets' OR base_name IN ('api_token', '.env', 'my_secrets', 'server.pem')
    OR (base_name = 'id_rsa' AND NOT path LIKE '%id_rsa.%') AS sensitive FROM files""",
)
def secret_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("doc_id", classify.is_sensitive("path").alias("sensitive"))


@query(
    "scan_prune",
    f"""WITH {FILES_SQL} SELECT doc_id, folder IN ('node_modules', 'lib_venv') AS pruned, base_name = 'poetry.lock' AS skipped FROM files""",
)
def scan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select(
        "doc_id", classify.in_noise_dir("path").alias("pruned"), classify.is_skipped_file("path").alias("skipped")
    )


IGNORE_RULES = ["docs/generated/", "*.txt", "!readme.txt", "src1?", "!src1[0-4]", "*.pem", "/src5/*/notes*"]
_IGNORE_SQL = """CASE WHEN regexp_matches(path, '^src5/.*/notes') THEN TRUE
    WHEN path LIKE '%.pem' THEN TRUE
    WHEN regexp_matches(path, '^src1[0-4]/') THEN FALSE
    WHEN regexp_matches(path, '^src1./') THEN TRUE
    WHEN path LIKE '%/readme.txt' THEN FALSE
    WHEN path LIKE '%.txt' THEN TRUE
    WHEN path LIKE 'docs/generated/%' THEN TRUE ELSE FALSE END"""


@query("ignore_last_match", f"WITH {FILES_SQL} SELECT doc_id, {_IGNORE_SQL} AS ignored FROM files")
def ignore_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("doc_id", classify.ignored("path", IGNORE_RULES).alias("ignored"))


@query(
    "ignore_lines",
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS raw
       FROM documents), t AS (SELECT doc_id, line_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l)
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN line = '' OR line LIKE '#%' THEN '' ELSE
    replace(regexp_replace(line, '\\s+#+[^\\\\\\n].*$', ''), '\\#', '#') END AS pattern FROM t""",
)
def ignore_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), classify.parse_ignore_line("raw").alias("pattern"))


_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"


@query("word_counts", f"SELECT doc_id, CAST({_WORDS.format('text')} AS BIGINT) AS words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", text.word_count("text").alias("words"))


_KEPT_SQL = f"""kept AS (SELECT {_CLASS_SQL} AS file_type, CAST({_WORDS.format('content')} AS BIGINT) AS words FROM files
   WHERE folder NOT IN ('node_modules', 'lib_venv', 'secrets') AND base_name NOT IN ('poetry.lock', 'api_token', '.env', 'my_secrets', 'server.pem')
   AND NOT (base_name = 'id_rsa' AND NOT path LIKE '%id_rsa.%'))"""


def _kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    kept = files.where(~classify.in_noise_dir("path") & ~classify.is_skipped_file("path") & ~classify.is_sensitive("path"))
    return kept.select(classify.classify("path", "content").alias("file_type"), text.word_count("content").alias("words"))


@query(
    "corpus_health",
    f"""WITH {FILES_SQL}, {_KEPT_SQL}, s AS (SELECT count(*) AS total_files,
       CAST(coalesce(sum(CASE WHEN file_type IN ('document', 'paper') THEN words END), 0) AS BIGINT) AS total_words FROM kept WHERE file_type IS NOT NULL)
    SELECT total_files, total_words, CASE WHEN total_files = 0 THEN '{fixed.WARN_EMPTY}'
    WHEN total_words < 5000 AND total_files <= 6 THEN '{fixed.WARN_SMALL}' END AS warning FROM s""",
)
def corpus_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.corpus_health(_kept_files(spark, sf_dir))


@query("bucket_counts", f"WITH {FILES_SQL}, {_KEPT_SQL} SELECT file_type, count(*) AS n_files FROM kept GROUP BY file_type")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.bucket_counts(_kept_files(spark, sf_dir))
