"""Queries over ledgers, snapshots, event logs, raw-file tools, model replies and exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import fixed
from loomgraph.operators import analyze, incremental, ledger, semantic
from loomgraph.plans.build import extract_records
from loomgraph.plans.registry import query
from loomgraph.session import cut, ensure_checkpoint_dir, spread
from loomgraph.sources import files as file_source
from loomgraph.sources import fragment_store, graph_json
from loomgraph.sources.tables import STAR_SQL, document_files, document_files_sql, star_edges, star_nodes, table
from loomgraph.streaming import events as event_log
from loomgraph.streaming import incremental as stream_state
from loomgraph.streaming import windows

# --- ledger: turns are model calls, events are phases -------------------------------

_MODEL = "CASE turn % 6 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini-2024' WHEN 2 THEN 'deepseek-chat' WHEN 3 THEN 'gpt-4.1-mini' WHEN 4 THEN 'local-7b' ELSE 'gpt-4.1' END"
_PURPOSE = "CASE role WHEN 'system' THEN 'ingest' WHEN 'user' THEN 'plan' ELSE 'answer' END"
_PHASE = "CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'ingest' ELSE 'answer' END"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "events")
    calls = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        F.lit("llm").alias("kind"),
        F.expr(_PURPOSE).alias("purpose"),
        F.expr(_MODEL).alias("model"),
        F.ceil(F.length("text") / fixed.CHARS_PER_TOKEN).cast("long").alias("prompt_tokens"),
        F.floor(F.length("text") / 10).cast("long").alias("completion_tokens"),
        (F.length("text") / 2.0).cast("double").alias("wall_ms"),
        F.when(F.length("text") % 13 == 0, "timeout").alias("error"),
        F.when(F.col("conv_id") % 2 == 0, "graph").otherwise("baseline").alias("side"),
    )
    phases = e.select(
        (-F.col("event_id") - 1).alias("seq"),
        F.lit("phase").alias("kind"),
        F.expr(_PHASE).alias("purpose"),
        F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("long").alias("prompt_tokens"),
        F.lit(None).cast("long").alias("completion_tokens"),
        F.col("value").alias("wall_ms"),
        F.lit(None).cast("string").alias("error"),
        F.when(F.col("user_id") % 2 == 0, "graph").otherwise("baseline").alias("side"),
    )
    return ledger.price(calls.unionByName(phases)).withColumn("superseded", F.lit(False))


def _cost_sql(prices: list[tuple[str, float, float]] = fixed.PRICES) -> str:
    arms = " ".join(
        f"WHEN starts_with(model, '{p}') THEN CAST(round_even(CAST(prompt_tokens / 1e6 * {float(a)!r} + completion_tokens / 1e6 * {float(b)!r} AS DECIMAL(30, 20)), 6) AS DOUBLE)"
        for p, a, b in prices
    )
    return f"CASE {arms} ELSE 0.0 END"


_LEDGER_SQL = f"""rows AS (
  SELECT conv_id * 1000 + turn AS seq, 'llm' AS kind, {_PURPOSE} AS purpose, {_MODEL} AS model, CAST(ceil(length(text) / 4.0) AS BIGINT) AS prompt_tokens,
         CAST(floor(length(text) / 10.0) AS BIGINT) AS completion_tokens, CAST(length(text) / 2.0 AS DOUBLE) AS wall_ms,
         CASE WHEN length(text) % 13 = 0 THEN 'timeout' END AS error, CASE WHEN conv_id % 2 = 0 THEN 'graph' ELSE 'baseline' END AS side FROM conversations
  UNION ALL SELECT -event_id - 1, 'phase', {_PHASE}, NULL, NULL, NULL, value, NULL, CASE WHEN user_id % 2 = 0 THEN 'graph' ELSE 'baseline' END FROM events),
ledger AS (SELECT *, CASE WHEN model IS NULL THEN 0.0 ELSE {_cost_sql()} END AS cost_usd FROM rows)"""


@query("call_costs", f"WITH {_LEDGER_SQL} SELECT seq, model, cost_usd FROM ledger WHERE kind = 'llm'")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).where(F.col("kind") == "llm").select("seq", "model", "cost_usd")


_OVERRIDES = '{"gpt-4o": [1.0, 2.0], "local-7b": [0.37, 0.29]}'


@query(
    "call_costs_overridden",
    f"WITH {_LEDGER_SQL} SELECT seq, model, {_cost_sql(ledger.price_list(_OVERRIDES))} AS cost_usd FROM (SELECT * EXCLUDE (cost_usd) FROM ledger) WHERE kind = 'llm'",
)
def call_costs_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings may change known prices and add new ones."""
    rows = ledger.price(_ledger(spark, sf_dir).drop("cost_usd"), ledger.price_list(_OVERRIDES))
    return rows.where(F.col("kind") == "llm").select("seq", "model", "cost_usd")


def _sums_sql(source: str) -> str:
    return f"""SELECT purpose, count(*) FILTER (kind = 'llm') AS calls, count(*) FILTER (kind = 'llm' AND error IS NOT NULL) AS failed_calls,
    CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
    round_even(coalesce(sum(cost_usd) FILTER (kind = 'llm'), 0.0), 6) AS cost_usd, round_even(coalesce(sum(wall_ms) FILTER (kind = 'llm'), 0.0), 1) AS wall_ms,
    round_even(coalesce(sum(wall_ms) FILTER (kind = 'phase'), 0.0), 1) AS phase_wall_ms,
    CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS total_tokens FROM {source} GROUP BY GROUPING SETS ((purpose), ())"""


@query("ledger_roll_up", f"WITH {_LEDGER_SQL} {_sums_sql('ledger')}")
def ledger_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.roll_up(_ledger(spark, sf_dir))


@query(
    "ledger_supersede",
    f"""WITH {_LEDGER_SQL}, last AS (SELECT max(seq) AS last_seq FROM ledger WHERE kind = 'llm' AND purpose = 'plan' AND error IS NULL)
    SELECT seq, purpose, CASE WHEN seq = last_seq THEN 0 ELSE prompt_tokens END AS prompt_tokens,
    CASE WHEN seq = last_seq THEN 0 ELSE completion_tokens END AS completion_tokens, CASE WHEN seq = last_seq THEN 0.0 ELSE cost_usd END AS cost_usd,
    seq = last_seq AS superseded FROM ledger, last""",
)
def ledger_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger.supersede_latest(_ledger(spark, sf_dir), "plan")
    return rows.select("seq", "purpose", "prompt_tokens", "completion_tokens", "cost_usd", "superseded")


_TOKENS = "sum(prompt_tokens + completion_tokens) FILTER (side = '{0}' AND purpose IN ({1}))"


@query(
    "ledger_break_even",
    f"""WITH {_LEDGER_SQL}, s AS (SELECT coalesce({_TOKENS.format('graph', "'ingest'")}, 0) AS b, coalesce({_TOKENS.format('graph', "'plan', 'answer'")}, 0) AS g,
       coalesce({_TOKENS.format('baseline', "'plan', 'read', 'answer'")}, 0) AS r, (SELECT count(*) FROM conversations WHERE role = 'user') AS n FROM ledger)
    SELECT CAST(b AS BIGINT) AS build_tokens, CAST(g AS BIGINT) AS graph_tokens, CAST(r AS BIGINT) AS baseline_tokens,
    CAST(g // n AS BIGINT) AS graph_per_question, CAST(r // n AS BIGINT) AS baseline_per_question,
    CAST(r - g AS BIGINT) AS saving, CASE WHEN r > g THEN CAST(b // (r - g) AS BIGINT) END AS questions_to_amortize FROM s""",
)
def ledger_break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "conversations").where(F.col("role") == "user").count()
    return ledger.break_even(_ledger(spark, sf_dir), questions)


@query(
    "ledger_by_side",
    f"""WITH {_LEDGER_SQL} SELECT purpose, CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (side = 'graph'), 0) AS BIGINT) AS graph_tokens,
    count(*) FILTER (kind = 'llm' AND side = 'graph') AS graph_calls,
    CAST(coalesce(sum(prompt_tokens + completion_tokens) FILTER (side = 'baseline'), 0) AS BIGINT) AS baseline_tokens,
    count(*) FILTER (kind = 'llm' AND side = 'baseline') AS baseline_calls FROM ledger GROUP BY purpose""",
)
def ledger_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.compare_purposes(_ledger(spark, sf_dir))


@query(
    "tools_used",
    """SELECT user_id AS question_no, count(*) AS steps,
    coalesce(nullif(string_agg(DISTINCT event_type, ', ' ORDER BY event_type) FILTER (event_type <> 'error'), ''), '-') AS tools FROM events GROUP BY user_id""",
)
def tools_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("question_no"), F.when(F.col("event_type") == "error", "finish").otherwise(F.col("event_type")).alias("action")
    )
    return ledger.tools_used(steps)


# --- snapshots ------------------------------------------------------------------------


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files now, stat index, contents): the index is stale for part of the documents."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "doc_id").alias("path")
    now = d.where(F.col("doc_id") % 10 != 9).select(path, F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns"))
    old_hash = F.when(F.col("doc_id") % 10 == 3, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    old = d.where(F.col("doc_id") % 10 != 8).select(
        path, F.col("n_chars").alias("size"), (F.col("doc_id") * 1000 - F.when(F.col("doc_id") % 10 < 5, 1).otherwise(0)).alias("mtime_ns"), old_hash.alias("hash")
    )
    return now, old, d.select(path, F.col("text").alias("content"))


_VERSION_SQL = """now AS (SELECT source || '/' || doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 10 <> 9),
old AS (SELECT source || '/' || doc_id AS path, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 10 <> 8)"""


@query("stat_hashes", f"WITH {_VERSION_SQL} SELECT path, hash FROM now")
def stat_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes with reads only where size or mtime moved."""
    return incremental.current_hashes(*_versions(spark, sf_dir)).select("path", "hash")


@query(
    "incremental_split",
    f"""WITH {_VERSION_SQL} SELECT now.path, CASE WHEN old.hash = now.hash THEN 'replay' ELSE 'extract' END AS action FROM now LEFT JOIN old ON now.path = old.path""",
)
def incremental_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, old, contents = _versions(spark, sf_dir)
    current = incremental.current_hashes(now, old, contents)
    replay, extract = incremental.split_cached(current, old)
    return replay.select("path", F.lit("replay").alias("action")).unionByName(extract.select("path", F.lit("extract").alias("action")))


@query(
    "change_summary",
    f"""WITH {_VERSION_SQL} SELECT CASE WHEN old.hash IS NULL THEN 'added' WHEN now.hash IS NULL THEN 'removed'
    WHEN old.hash = now.hash THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n FROM now FULL JOIN old ON now.path = old.path GROUP BY 1""",
)
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, old, contents = _versions(spark, sf_dir)
    return incremental.change_summary(incremental.current_hashes(now, old, contents), old)


_STORED_SQL = """SELECT version, source || '/' || doc_id || '.md' AS path,
    sha256(CASE WHEN version = 1 AND doc_id % 10 = 3 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS hash,
    CASE WHEN version > 0 AND doc_id % 10 = 8 OR version = 1 AND doc_id % 10 = 3 THEN 1 ELSE 0 END AS delta, 1 AS anchors
    FROM documents CROSS JOIN (VALUES (0), (1), (2)) v(version) WHERE NOT (version = 0 AND doc_id % 10 = 8 OR version = 1 AND doc_id % 10 = 9)"""


@query("fragment_store_versions", _STORED_SQL)
def fragment_store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files in three versions of a fragment store, each read back.

    Version 1 adds, changes and removes a tenth each; version 2 takes the change back, so it needs no extraction.
    """
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("turn", F.col("doc_id") % 10)
    store = _stream_folder(spark)
    path = F.concat("source", F.lit("/"), "doc_id", F.lit(".md"))
    out = []
    for version, (absent, changed) in enumerate([(8, -1), (9, 3), (-1, -1)]):
        content = F.when(F.col("turn") == changed, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
        files = d.where(F.col("turn") != absent).select(
            path.alias("path"), F.length("text").cast("long").alias("size"), F.lit(version).cast("long").alias("mtime_ns"), content.alias("content")
        )
        files = files.withColumn("hash", F.sha2("content", 256)).withColumn("file_type", F.lit("document")).withColumn("words", F.lit(0).cast("long"))
        number, _, _ = fragment_store.refresh(spark, files, store, extract_records)
        nodes = fragment_store.read(spark, store, number)["nodes"]
        anchors = nodes.where(F.col("label") == F.element_at(F.split("source_file", "/"), -1)).groupBy("source_file").agg(F.count("*").alias("anchors"))
        listed = fragment_store.file_list(spark, store, number).join(anchors.withColumnRenamed("source_file", "path"), "path", "left")
        out.append(listed.select(F.lit(number).alias("version"), "path", "hash", "delta", "anchors"))
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- streams ----------------------------------------------------------------------------


def _stream_folder(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


@query(
    "event_replay",
    """SELECT event_id + 1 AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'tool_call' WHEN 'view' THEN 'tool_result'
    WHEN 'signup' THEN 'run_started' ELSE 'plan' END AS type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table written as a log and drained through a stream."""
    e = table(spark, sf_dir, "events")
    kind = (
        F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "tool_call")
        .when(F.col("event_type") == "view", "tool_result").when(F.col("event_type") == "signup", "run_started").otherwise("plan")
    )
    folder = _stream_folder(spark)
    event_log.append_events(
        e.select((F.col("event_id") + 1).alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), kind.alias("type"), F.col("props").alias("payload")),
        f"{folder}/log",
    )
    event_log.deliver(event_log.tail(spark, f"{folder}/log"), f"{folder}/sink", f"{folder}/offsets").awaitTermination()
    drained = spark.read.parquet(f"{folder}/sink")
    return drained.select("seq", "type", F.get_json_object("payload", "$.k").cast("long").alias("k"))


@query(
    "stream_latest_version",
    "SELECT 'user/' || user_id AS path, arg_max(event_type, event_id) AS hash FROM events GROUP BY user_id",
)
def stream_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state over a stream of versions: the last report of a path is its newest content.

    Events arrive in event_id order, so the id serves as the version.
    """
    e = table(spark, sf_dir, "events")
    folder = _stream_folder(spark)
    e.select(F.concat(F.lit("user/"), "user_id").alias("path"), F.col("event_type").alias("hash"), F.col("event_id").alias("version")).write.parquet(f"{folder}/in")
    versions = spark.readStream.schema("path string, hash string, version long").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    event_log.deliver(stream_state.changed_paths(versions), f"{folder}/out", f"{folder}/offsets").awaitTermination()
    reported = spark.read.parquet(f"{folder}/out")
    return reported.groupBy("path").agg(F.max_by("hash", "version").alias("hash"))


def _event_stream(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The event table, a tenth of it sent twice, as a stream."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.unionAll(e.where("event_id % 10 = 0")).write.parquet(f"{folder}/in")
    return spark.readStream.schema(windows.EVENT).parquet(f"{folder}/in")


def _drained(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    event_log.deliver(stream, f"{folder}/out", f"{folder}/offsets").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_CLOSED_SQL = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)"


@query(
    "event_windows",
    f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED_SQL} GROUP BY ALL""",
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows by a stream with repeated events; the last hour before the end of the stream is still open."""
    folder = _stream_folder(spark)
    closed = _drained(spark, windows.tumbling(_event_stream(spark, sf_dir, folder), "1 hour", "1 hour"), folder)
    return closed.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "event_sessions",
    f"""WITH marked AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 4 HOUR, TRUE) AS fresh FROM events),
    numbered AS (SELECT *, sum(fresh::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM marked)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end",
    count(*) AS n, round(sum(value), 2) AS total FROM numbered GROUP BY user_id, no HAVING max(ts) + INTERVAL 4 HOUR <= {_CLOSED_SQL}""",
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user by a stream with repeated events."""
    folder = _stream_folder(spark)
    over = _drained(spark, windows.sessions(_event_stream(spark, sf_dir, folder), "4 hours", "1 hour"), folder)
    return over.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "end")})


# --- raw-file tools ------------------------------------------------------------------------

_FILES_SQL = document_files_sql()


def _raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select(F.col("path").alias("rel"), "content", F.octet_length("content").cast("long").alias("size"))


@query(
    "raw_list_files",
    f"""WITH {_FILES_SQL} SELECT path AS rel, path || ' (' || strlen(content) || 'B)' AS entry FROM files WHERE folder <> 'node_modules'""",
)
def raw_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_source.list_files(_raw_files(spark, sf_dir))


_GREP = "token|[0-9]{3}-[0-9]{4}"
_GREP_SQL = f"""WITH {_FILES_SQL}, l AS (SELECT path, generate_subscripts(string_split(content, chr(10)), 1) AS n, unnest(string_split(content, chr(10))) AS t FROM files
  WHERE folder <> 'node_modules')
SELECT path AS rel, CAST(n AS INTEGER) AS line, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS hit FROM l WHERE regexp_matches(t, '{_GREP}')"""


@query("raw_grep_hits", _GREP_SQL)
def raw_grep_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_source.grep_hits(_raw_files(spark, sf_dir), _GREP)


@query("raw_grep", _GREP_SQL)
def raw_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_source.grep(_raw_files(spark, sf_dir), _GREP)


@query(
    "raw_read_files",
    f"""WITH {_FILES_SQL} SELECT path AS rel, content FROM files""",
)
def raw_read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_source.read_files(_raw_files(spark, sf_dir))


# --- model replies -------------------------------------------------------------------------------


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as replies: their words are concepts, neighbours are linked, some replies are broken."""
    # Two words at least, which the pattern tells without listing them. Words need no escapes: the JSON is put together as text.
    d = table(spark, sf_dir, "documents").where(F.lower("text").rlike("(?s)[a-z]{4}[^a-z].*?[a-z]{4}"))
    ws = spread(d).select("doc_id", "lang", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("w"))

    def listed(name: str, items: Column, *parts: Callable[..., Column | str]) -> Column:
        each = lambda x, i: F.concat(*(F.lit(p) if isinstance(p, str) else p(x, i) for p in parts))
        return F.concat(F.lit(f'"{name}":['), F.array_join(F.transform(items, each), ","), F.lit("]"))

    word = lambda w, _: w
    label = lambda w, i: F.when(i % 7 == 3, "").otherwise(F.initcap(w))
    nodes = listed("nodes", F.col("w"), '{"id":"', word, '","label":"', label, '","summary":" about ', word, '"}')
    relation = lambda w, i: F.when(i % 3 == 0, "semantically_similar_to").when(i % 3 == 1, "mentions").otherwise("references")
    score = lambda w, _: (F.length(w) / 16.0).cast("string")
    following = lambda _, i: F.try_element_at("w", i + 2)
    sources = F.slice("w", 1, F.size("w") - 1)
    edges = listed("edges", sources, '{"source":"', word, '","target":"', following, '","relation":"', relation, '","confidence_score":', score, "}")
    links = listed("code_links", F.col("w"), '{"concept_id":"', word, '","code_name":" ', word, '()"}')
    body = F.concat(F.lit("{"), nodes, F.lit(","), edges, F.lit(","), links, F.lit("}"))
    reply = semantic.once(
        body,
        lambda b: F.when(F.col("lang") == "de", F.concat(F.lit("```json\n"), b, F.lit("\n```")))
        .when(F.col("lang") == "fr", F.concat(F.lit("Here it is: "), b, F.lit(" done")))
        .when(F.col("lang") == "es", F.left(b, F.length(b) - 3))
        .otherwise(b),
    )
    return ws.select(F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("path"), reply.alias("reply"), F.lit(None).cast("string").alias("error"))


_REPLY_SQL = """w AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM documents),
ok AS (SELECT doc_id, 'd' || doc_id || '.md' AS path, w FROM w WHERE len(w) >= 2 AND lang <> 'es'),
n AS (SELECT path, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM ok),
concept AS (SELECT path, word, min(i) AS i FROM n WHERE i % 7 <> 3 GROUP BY path, word),
e AS (SELECT path, i - 1 AS i, w[i] AS s, w[i + 1] AS t FROM (SELECT path, w, unnest(range(1, len(w))) AS i FROM ok)),
l AS (SELECT path, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM ok)"""


@query(
    "concept_nodes",
    f"""WITH {_REPLY_SQL} SELECT path AS source_file, 'concept_' || word AS id, upper(word[1]) || word[2:] AS label, 'about ' || word AS summary FROM concept
    UNION ALL SELECT path, 'd' || doc_id || '_md', path, NULL FROM ok""",
)
def concept_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.fragments(_replies(spark, sf_dir))["nodes"].select("source_file", "id", "label", "summary")


@query(
    "concept_edges",
    f"""WITH {_REPLY_SQL} SELECT path AS source_file, 'concept_' || s AS source, 'concept_' || t AS target,
    CASE i % 3 WHEN 0 THEN 'semantically_similar_to' ELSE 'references' END AS relation, least(1.0, length(s) / 16.0) AS weight FROM e
    WHERE s <> t AND EXISTS (SELECT 1 FROM concept c WHERE c.path = e.path AND c.word = s) AND EXISTS (SELECT 1 FROM concept c WHERE c.path = e.path AND c.word = t)
    UNION ALL SELECT path, replace(path, '.', '_'), 'concept_' || word, 'contains', 1.0 FROM concept""",
)
def concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.fragments(_replies(spark, sf_dir))["edges"].select("source_file", "source", "target", "relation", "weight")


@query(
    "concept_code_links",
    f"""WITH {_REPLY_SQL} SELECT path AS fragment_key, 'concept_' || word AS concept_id, word || '()' AS code_name FROM l
    WHERE EXISTS (SELECT 1 FROM concept c WHERE c.path = l.path AND c.word = l.word)""",
)
def concept_code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.fragments(_replies(spark, sf_dir))["links"].select("fragment_key", "concept_id", "code_name")


@query("reply_errors", "SELECT 'd' || doc_id || '.md' AS path, 'llm returned unparseable JSON' AS error FROM documents WHERE lang = 'es' AND len(regexp_extract_all(lower(text), '[a-z]{4,}')) >= 2")
def reply_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.errors(_replies(spark, sf_dir))


@query(
    "semantic_prompts",
    """WITH parts AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 40000.0) AS BIGINT), 1))) AS part FROM documents),
    bodies AS (SELECT doc_id, part, substr(text, part * 40000 + 1, 40000) AS body FROM parts)
    SELECT doc_id || '.md' AS path, CAST(part AS INTEGER) AS part, left(sha256(body), 16) AS hash, 'Document ' || doc_id || '.md (sha256 ' || left(sha256(body), 16) || ') follows.' || chr(10) || '-----' || chr(10)
    || body || chr(10) || '-----' || chr(10) || 'End of the document; answer in JSON.' AS prompt FROM bodies""",
)
def semantic_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return semantic.prompts(docs, token_budget=10_000)


@query(
    "action_tools",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN NULL ELSE role || (turn % 4) END AS tool FROM conversations""",
)
def action_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions in replies that think aloud, are cut short, or have text around them."""
    tool = F.concat("role", (F.col("turn") % 4).cast("string"))
    flat = F.concat(F.lit('{"tool": "'), tool, F.lit('"}'))
    reply = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<thought>"), "text", F.lit(" {1} </thought> "), flat))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("<thought>"), "text"))
        .when(F.col("turn") % 4 == 2, F.concat("text", F.lit(" "), flat, F.lit(" "), "text"))
        .otherwise(F.concat(F.lit('{"tool": "'), tool, F.lit('", "args": {"n": 1}}')))
    )
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", semantic.action_object(reply).alias("action"))
    return found.select("conv_id", "turn", F.get_json_object("action", "$.tool").alias("tool"))


_JSON_KEYS = ", ".join(f"'{w}'" for w in fixed.JSON_NOISE_LABELS)


@query(
    "json_key_noise",
    f"""WITH w AS (SELECT page_id, unnest(regexp_extract_all(html, '[A-Za-z]+')) AS label FROM pages WHERE page_id % 3 <> 1)
    SELECT page_id, count(*) AS n FROM w WHERE lower(label) IN ({_JSON_KEYS}) GROUP BY page_id""",
)
def json_key_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages as labels; a third of the pages is stored under another suffix, where no key is noise."""
    word = F.explode(F.regexp_extract_all("html", F.lit("[A-Za-z]+"), F.lit(0))).alias("label")
    path = F.concat("page_id", F.when(F.col("page_id") % 3 == 1, ".md").otherwise(".JSON")).alias("source_file")
    words = table(spark, sf_dir, "pages").select("page_id", path, word)
    return words.where(analyze.is_json_key()).groupBy("page_id").agg(F.count("*").alias("n"))


# --- export ------------------------------------------------------------------------------------------


@query(
    "node_link_rows",
    f"""WITH {STAR_SQL} SELECT 'nodes' AS section, id, '{{"id":"' || id || '","label":"' || label || '","file_type":"' || file_type || '","source_file":"' || source_file
    || '","source_location":"L' || (CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) + 1) || '"}}' AS json FROM nodes
    UNION ALL SELECT 'links', source || ' ' || target, '{{"source":"' || source || '","target":"' || target || '","relation":"' || relation || '","confidence":"' || confidence || '"' ||
    CASE WHEN confidence_score IS NULL THEN '' ELSE ',"confidence_score":' || confidence_score END || ',"source_file":"' ||
    CASE WHEN relation = 'contains' AND target LIKE 'nation%' THEN 'geo/nation.md' WHEN target LIKE 'customer%' THEN 'trade/customer.py' WHEN relation = 'contains' THEN 'trade/supplier.go'
    WHEN relation = 'references' THEN 'trade/orders.py' ELSE 'trade/lineitem.py' END || '","weight":' || weight || '}}' FROM edges""",
)
def node_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_json.node_link_rows(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))


@query(
    "drawing_rows",
    f"""WITH {STAR_SQL} SELECT 'nodes' AS section, '{{"id":"' || id || '","label":"' || label || '","file_type":"' || file_type || '","source_file":"' || source_file || '"}}' AS json FROM nodes
    UNION ALL SELECT 'links', '{{"source":"' || source || '","target":"' || target || '","relation":"' || relation || '","confidence":"' || confidence || '"}}' FROM edges""",
)
def drawing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_json.drawing_rows(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))
