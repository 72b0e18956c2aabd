"""Markdown structure: headings, their nesting, links between documents.

Everything is lines, regular expressions and one window per file; no parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import fixed, ids, paths, text
from loomgraph.operators import classify

# Markdown syntax
HEADING = r"(?s)^(#{1,6})\s+(.+?)\s*#*\s*$"
INLINE_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
WIKI_LINK = r"\[\[([^\]]+)\]\]"
EXTERNAL = ("http://", "https://", "mailto:")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def headings(files: DataFrame) -> DataFrame:
    """(path, line, level, title, id, parent) for every heading of every file.

    The parent is the latest heading one level up, unless a higher heading came
    since; failing that the heading (or file) just above when it is higher.
    """
    lines = files.select("path", F.posexplode(F.split("content", LINE_BREAK)).alias("at", "text"))
    found = (
        lines.where(F.col("text").startswith("#") & F.col("text").rlike(HEADING))
        .select(
            "path",
            (F.col("at") + 1).alias("line"),
            F.length(F.regexp_extract("text", HEADING, 1)).alias("level"),
            F.btrim(F.regexp_extract("text", HEADING, 2)).alias("title"),
        )
        .where(F.col("title") != "")
        .withColumn("id", ids.make_id(paths.stem("path"), "title"))
    )
    order = Window.partitionBy("path").orderBy("line")
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct("line", "level", "id")
    latest = [F.last(F.when(F.col("level") == n, here), ignorenulls=True).over(above) for n in range(1, 7)]
    prev_level = F.coalesce(F.lag("level").over(order), F.lit(0))
    prev_id = F.coalesce(F.lag("id").over(order), ids.document_id("path"))
    near = F.array_max(F.filter(F.array(*latest), lambda h: h.isNotNull() & (h["level"] < F.col("level"))))
    parent = F.when(near["level"] == F.col("level") - 1, near["id"]).when(F.col("level") > prev_level, prev_id)
    return found.withColumn("parent", parent)


def _pairs(content: Column, pattern: str) -> Column:
    both = [F.regexp_extract_all(content, F.lit(pattern), F.lit(i)) for i in (1, 2)]
    return F.arrays_zip(both[0].alias("text"), both[1].alias("target"))


def links(files: DataFrame) -> DataFrame:
    """(path, at, name): names of the documents a file links to, inline links first."""
    inline = files.select("path", F.posexplode(_pairs(F.col("content"), INLINE_LINK)).alias("at", "m"))
    target = F.btrim(F.col("m.target"))
    outside = target == ""
    for prefix in EXTERNAL:
        outside = outside | target.startswith(prefix)
    local = F.substring_index(F.substring_index(target, "#", 1), "?", 1)
    inline = inline.where(~outside & (local != "")).select("path", "at", paths.basename(local).alias("name"))
    wiki = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(WIKI_LINK), F.lit(1))).alias("at", "name"))
    after_inline = F.col("at").cast("long") + 1_000_000_000
    wiki = wiki.select("path", after_inline.alias("at"), F.btrim(F.substring_index("name", "|", 1)).alias("name"))
    return inline.unionByName(wiki.where(F.col("name") != ""))


def extract_markdown(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) records of ``files(path, content)``, keyed by path."""
    kind = files.select(
        "path",
        F.when(classify.markdown_is_paper("content"), "paper").otherwise("document").alias("file_type"),
        ids.document_id("path").alias("file_id"),
    )
    heads, refs = headings(files), links(files).withColumn("id", ids.make_id("name"))
    step = 10_000_000_000
    rows = [
        kind.select("path", F.col("file_id").alias("id"), text.sanitize_label(paths.basename("path")).alias("label"),
                    F.lit("L1").alias("source_location"), F.lit(0).cast("long").alias("pos")),
        heads.groupBy("path", "id").agg(F.min_by("title", "line").alias("label"), F.min("line").alias("line"))
        .select("path", "id", "label", F.concat(F.lit("L"), "line").alias("source_location"), (F.col("line") + step).alias("pos")),
        refs.join(heads.select("path", "id").distinct(), ["path", "id"], "left_anti")
        .groupBy("path", "id").agg(F.min_by("name", "at").alias("label"), F.min("at").alias("at"))
        .select("path", "id", "label", F.lit(None).cast("string").alias("source_location"), (F.col("at") + 2 * step).alias("pos")),
    ]
    nodes = rows[0].unionByName(rows[1]).unionByName(rows[2]).join(kind.select("path", "file_type"), "path")
    file_id = ids.document_id("path")
    place = F.concat(F.lit("L"), "line")
    contains = heads.select(
        "path", F.explode(F.array_compact(F.array(
            F.struct(file_id.alias("source"), F.col("id").alias("target"), (F.col("line").cast("long") * 2).alias("pos")),
            F.when(F.col("parent") != F.col("id"), F.struct(F.col("parent").alias("source"), F.col("id").alias("target"), (F.col("line").cast("long") * 2 + 1).alias("pos"))),
        ))).alias("e"), place.alias("source_location"),
    ).select("path", "e.source", "e.target", F.lit("contains").alias("relation"), "source_location", "e.pos")
    references = refs.select(
        "path", file_id.alias("source"), F.col("id").alias("target"), F.lit("references").alias("relation"),
        F.lit(None).cast("string").alias("source_location"), (F.col("at") + 2 * step).alias("pos"),
    )
    edges = contains.unionByName(references)
    return _node_records(nodes), _edge_records(edges)


def _node_records(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "id", "label", "file_type", F.col("path").alias("source_file"), "source_location",
        F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("summary"),
        F.col("path").alias("fragment_key"), F.col("pos").cast("long").alias("pos"),
    )


def _edge_records(edges: DataFrame) -> DataFrame:
    return edges.select(
        "source", "target", "relation", F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("double").alias("confidence_score"),
        F.col("path").alias("source_file"), "source_location", F.lit(1.0).alias("weight"),
        F.col("path").alias("fragment_key"), F.col("pos").cast("long").alias("pos"),
    )


def markdown_files(files: DataFrame) -> DataFrame:
    return files.where(F.lower(paths.suffix("path")).isin(fixed.MARKDOWN_EXTENSIONS))
