"""Code structure: from facts per file to node, edge, call and definition records."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import fixed, ids, paths, text
from loomgraph.functions.slices import in_slices
from loomgraph.functions.source_facts import source_facts
from loomgraph.session import cut, spread

DEFINING = ["class", "function", "struct", "enum", "trait", "impl", "type"]

_FACT = pa.struct([("line", pa.int64()), ("kind", pa.string()), ("name", pa.string()), ("owner", pa.string())])
_SCANNED = pa.schema([("path", pa.string()), ("language", pa.string()), ("file_id", pa.string()), ("facts", pa.list_(_FACT)), ("error", pa.string())])
_SCANNED_DDL = (
    "path string, language string, file_id string, facts array<struct<line: bigint, kind: string, name: string, owner: string>>, error string"
)


def _facts_of_file(row: dict) -> dict:
    facts, error = [], None
    try:
        facts = [dict(zip(("line", "kind", "name", "owner"), f)) for f in source_facts(row["content"], row["language"])]
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        error = f"{type(e).__name__}: {e}"
    return {"path": row["path"], "language": row["language"], "file_id": row["file_id"], "facts": facts, "error": error}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return in_slices(batches, _facts_of_file, "facts", _SCANNED)


def language_of(path: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.GRAMMAR_BY_EXTENSION.items() for x in kv])
    return F.try_element_at(table, F.lower(paths.suffix(path)))


def known_files(files: DataFrame) -> DataFrame:
    """Files with a known grammar; others have no structure."""
    known = files.withColumn("language", language_of("path")).where(F.col("language").isNotNull())
    return known.select("path", "language", ids.code_file_id("path").alias("file_id"), "content")


def scan(files: DataFrame) -> DataFrame:
    """(path, language, file_id, facts, error) of every file with a known grammar."""
    return spread(known_files(files)).mapInArrow(_scan, _SCANNED_DDL)


def _bare_name(name: Column) -> Column:
    return F.ltrim(F.rtrim(F.btrim(name), F.lit("()")), F.lit("."))


def facts_of(scanned: DataFrame) -> DataFrame:
    """(path, language, at, line, kind, name, owner, id, owner_id, file_id), in reading order."""
    name = F.btrim(F.when(F.col("f.kind") == "import", F.btrim(F.btrim("f.name"), F.lit("'\""))).otherwise(F.col("f.name")))
    rows = scanned.select("path", "language", "file_id", F.posexplode("facts").alias("at", "f")).select(
        "path", "language", "file_id", "at", "f.line", "f.kind", name.alias("name"), "f.owner"
    )
    builtin_base = (F.col("language") == "python") & (F.col("kind") == "inherits") & F.col("name").isin(fixed.BUILTIN_CALLS)
    full = F.when(F.col("kind") == "import", ids.joined(F.lit("mod"), "name")).when(F.col("kind") != "call", ids.joined("name"))
    return rows.where((F.col("name") != "") & ~builtin_base).select(
        "*", ids.normalize_id(full).alias("id"), ids.make_id("owner").alias("owner_id")
    )


def edge_records(facts: DataFrame) -> DataFrame:
    kind = F.col("kind")
    defining = kind.isin(DEFINING)
    rows = facts.where(defining | kind.isin("import", "inherits", "method")).select(
        F.when(defining | (kind == "import"), F.col("file_id")).otherwise(F.col("owner_id")).alias("source"),
        F.col("id").alias("target"),
        F.when(kind == "import", "imports").when(defining, "contains").otherwise(kind).alias("relation"),
        F.lit("EXTRACTED").alias("confidence"),
        F.lit(None).cast("double").alias("confidence_score"),
        F.col("path").alias("source_file"),
        F.concat(F.lit("L"), "line").alias("source_location"),
        F.lit(1.0).alias("weight"),
        F.col("path").alias("fragment_key"),
        F.col("at").cast("long").alias("pos"),
    )
    return rows


def node_records(files: DataFrame, facts: DataFrame) -> DataFrame:
    """File anchors, definitions, modules, and stubs for everything else an edge touches.

    Within a file the first definition of an id outranks a module, and both
    outrank a stub; the node keeps the place of its first mention.
    """
    kind = F.col("kind")
    defining = kind.isin(DEFINING)
    mention = F.struct(
        F.when(defining, 0).when(kind == "import", 1).otherwise(2).alias("rank"),
        F.col("at").cast("long").alias("at"),
        F.when(kind == "function", F.concat("name", F.lit("()"))).when(defining | (kind == "import"), F.col("name")).alias("label"),
        F.when(defining, F.concat(F.lit("L"), "line")).alias("location"),
        F.when(defining, kind).alias("kind"),
        F.col("id").alias("id"),
    )
    owner = F.when(
        kind.isin("inherits", "method"),
        F.struct(
            F.lit(2).alias("rank"),
            F.col("at").cast("long").alias("at"),
            F.lit(None).cast("string").alias("label"),
            F.lit(None).cast("string").alias("location"),
            F.lit(None).cast("string").alias("kind"),
            F.col("owner_id").alias("id"),
        ),
    )
    mentions = facts.where(kind != "call").select("path", F.explode(F.array_compact(F.array(mention, owner))).alias("m"))
    best = (
        mentions.select("path", "m.*")
        .groupBy("path", "id")
        .agg(F.min_by(F.struct("label", "location", "kind"), F.struct("rank", "at")).alias("b"), F.min("at").alias("at"))
    )
    anchors = files.select(
        F.col("file_id").alias("id"),
        text.sanitize_label(paths.basename("path")).alias("label"),
        F.lit("L1").alias("source_location"),
        F.lit(None).cast("string").alias("kind"),
        F.lit(-1).cast("long").alias("pos"),
        "path",
    )
    found = best.select(
        "id",
        F.coalesce("b.label", text.title_label("id")).alias("label"),
        F.col("b.location").alias("source_location"),
        F.col("b.kind").alias("kind"),
        F.col("at").alias("pos"),
        "path",
    )
    return anchors.unionByName(found).select(
        "id", "label", F.lit("code").alias("file_type"), F.col("path").alias("source_file"), "source_location", "kind",
        F.lit(None).cast("string").alias("summary"), F.col("path").alias("fragment_key"), "pos",
    )


def call_records(facts: DataFrame) -> DataFrame:
    """Calls by file, builtins dropped; the caller is always the file."""
    clean = _bare_name(F.col("name"))
    return (
        facts.where((F.col("kind") == "call") & ~F.col("name").isin(fixed.BUILTIN_CALLS))
        .withColumn("clean", clean)
        .where((F.col("clean") != "") & ~F.col("clean").isin(fixed.BUILTIN_CALLS))
        .select(
            F.col("file_id").alias("caller"),
            F.col("clean").alias("name"),
            F.concat(F.lit("L"), "line").alias("location"),
            F.col("path").alias("source_file"),
            F.col("path").alias("fragment_key"),
            F.col("at").cast("long").alias("pos"),
        )
    )


def definition_records(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("kind").isin(DEFINING)).select(
        F.lower(_bare_name(F.col("name"))).alias("label"),
        F.col("id").alias("node_id"),
        F.col("path").alias("fragment_key"),
        F.col("at").cast("long").alias("pos"),
    )


def extract_code(files: DataFrame, stored: bool = False) -> dict[str, DataFrame]:
    """nodes, edges, calls, definitions, errors of ``files(path, content)``.

    ``stored`` writes what the parser found first: for callers that use several
    of the results, so that each file is parsed once.
    """
    scanned = cut(scan(files)) if stored else scan(files)
    facts = facts_of(scanned)
    return {
        "nodes": node_records(scanned if stored else known_files(files), facts),
        "edges": edge_records(facts),
        "calls": call_records(facts),
        "definitions": definition_records(facts),
        "errors": scanned.where(F.col("error").isNotNull()).select("path", "error"),
    }
