"""Fragments to one graph: ordered node merge, ordered edge merge, dangling filter.

Records carry ``fragment_key`` and ``pos``; their pair is the order in which a
sequential build would have seen them, and it decides every tie here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.functions import text


def ordinal():
    return F.struct("fragment_key", "pos")


def merge_nodes(records: DataFrame) -> DataFrame:
    """One row per id.

    The first record with a location fixes label, type and source; without one
    the last record does. ``kind`` and ``summary`` come from the latest record
    up to that anchor that has them, else from the earliest after it.

    Two partial aggregations; only records that carry an optional value go
    through the second one.
    """
    located = F.coalesce(F.col("source_location"), F.lit("")) != ""
    body = F.struct("label", "file_type", "source_file", "source_location")
    r = records.withColumn("ord", ordinal())
    anchors = r.groupBy("id").agg(
        F.min_by(F.when(located, body), F.when(located, F.col("ord"))).alias("first_located"),
        F.min(F.when(located, F.col("ord"))).alias("anchor"),
        F.max_by(body, "ord").alias("latest"),
        F.min("ord").alias("ord"),
    )
    chosen = F.coalesce("first_located", "latest")
    merged = anchors.select(
        "id",
        F.coalesce(F.nullif(chosen["label"], F.lit("")), F.col("id")).alias("label"),
        text.file_type(chosen["file_type"]).alias("file_type"),
        chosen["source_file"].alias("source_file"),
        chosen["source_location"].alias("source_location"),
        "ord",
        "anchor",
    )
    optional = (
        r.where(F.col("kind").isNotNull() | F.col("summary").isNotNull())
        .select("id", "ord", "kind", "summary")
        .join(anchors.select("id", "anchor"), "id")
    )
    upto = F.col("anchor").isNull() | (F.col("ord") <= F.col("anchor"))
    picks = []
    for field in ("kind", "summary"):
        has = F.col(field).isNotNull()
        before = F.max_by(F.when(has & upto, F.col(field)), F.when(has & upto, F.col("ord")))
        after = F.min_by(F.when(has & ~upto, F.col(field)), F.when(has & ~upto, F.col("ord")))
        picks.append(F.coalesce(before, after).alias(field))
    extras = optional.groupBy("id").agg(*picks)
    return (
        merged.drop("anchor")
        .join(extras, "id", "left")
        .select("id", "label", "file_type", "source_file", "source_location", "kind", "summary", "ord")
    )


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi")


def pair_keys(directed: bool = False):
    """Identity of an edge: its ordered or unordered pair of ends."""
    if directed:
        return F.col("source").alias("k1"), F.col("target").alias("k2")
    return F.least("source", "target").alias("k1"), F.greatest("source", "target").alias("k2")


_EDGE_VALUES = ["source", "target", "relation", "confidence", "source_file", "source_location", "weight"]


def merge_edges(records: DataFrame, directed: bool = False) -> DataFrame:
    """At most one edge per pair.

    Reading a pair's records in order: a repeat of the current relation is
    skipped; another relation replaces the current edge unless that edge is
    EXTRACTED. So the result is the head of a run of equal relations: the first
    run headed by an EXTRACTED record, else the last run. A replaced edge leaves
    its score behind when the new one has none.

    A pair that its first record settles (it is EXTRACTED, or the relation never changes)
    keeps that record. Records are shuffled and sorted once, by pair and order; everything
    else is read off the sorted rows, so the disk holds no second copy of them.
    """
    k1, k2 = pair_keys(directed)
    values = [c for c in _EDGE_VALUES if c not in ("source", "target")]
    # The ends travel once, as the pair: as it stands (0), turned round (1), or with a null source (2) or target (3).
    turned = F.when(F.col("source").isNull() & F.col("target").isNotNull(), 2).when(F.col("target").isNull() & F.col("source").isNotNull(), 3)
    side = F.lit(0) if directed else F.coalesce(turned, F.when(F.col("source") != F.least("source", "target"), 1), F.lit(0))
    r = records.select(k1, k2, side.cast("byte").alias("side"), *values, "confidence_score", "fragment_key", "pos").repartition("k1", "k2")
    source = F.when(F.col("side") == 1, F.col("k2")).when(F.col("side") != 2, F.col("k1"))
    target = F.when(F.col("side") == 1, F.col("k1")).when(F.col("side") != 3, F.col("k2"))
    # Sorted by a number first, since ids begin alike.
    r = r.withColumn("h", F.xxhash64("k1", "k2"))
    pair = Window.partitionBy("h", "k1", "k2")
    upto = pair.orderBy("fragment_key", "pos")
    frozen = F.col("confidence") == "EXTRACTED"
    mixed = F.min("relation").over(pair) != F.max("relation").over(pair)
    seen = r.select(
        "*",
        F.lag("relation").over(upto).alias("before"),
        F.row_number().over(upto).alias("nth"),
        F.coalesce(mixed & (F.first("confidence").over(upto) != "EXTRACTED"), F.lit(False)).alias("contested"),
    )
    head = F.col("before").isNull() | (F.col("before") != F.col("relation"))
    frozen_at = F.min(F.when(head & frozen, ordinal())).over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = seen.withColumn("frozen_at", frozen_at)
    known = F.col("k1").isNotNull() & F.col("k2").isNotNull()
    counts = known & head & (F.col("frozen_at").isNull() | (ordinal() <= F.col("frozen_at")))
    scored = F.col("confidence_score").isNotNull()
    return (
        seen.where(F.when(F.col("contested"), counts).otherwise(F.col("nth") == 1))
        .groupBy("h", "k1", "k2")
        .agg(
            F.max_by(F.struct("side", *values), ordinal()).alias("e"),
            F.max_by(F.when(scored, F.col("confidence_score")), F.when(scored, ordinal())).alias("confidence_score"),
            F.min(ordinal()).alias("ord"),
        )
        .select("k1", "k2", "e.*", "confidence_score", "ord")
        .withColumns({"source": source, "target": target})
        .select("k1", "k2", *_EDGE_VALUES, "confidence_score", "ord")
    )


def attach_definitions(nodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """``defines``: the first definition label recorded for a node."""
    first = definitions.groupBy(F.col("node_id").alias("id")).agg(F.min_by("label", ordinal()).alias("defines"))
    return nodes.join(first, "id", "left")


def assemble(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Validated records to a graph (nodes, edges)."""
    merged = merge_nodes(nodes)
    return merged, merge_edges(drop_dangling(edges, merged), directed)


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge from both ends as (id, other, ...); a self-loop stays single."""
    ends = F.when(
        F.col("source") == F.col("target"), F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")))
    ).otherwise(
        F.array(
            F.struct(F.col("source").alias("id"), F.col("target").alias("other")),
            F.struct(F.col("target").alias("id"), F.col("source").alias("other")),
        )
    )
    rest = [c for c in edges.columns if c not in ("id", "other")]
    return edges.select(F.explode(ends).alias("end"), *rest).select("end.id", "end.other", *rest)


def degrees(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Incident edges per node, or per node of ``of``; a self-loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    if of is not None:
        ends = ends.join(of.select("id"), "id", "left_semi")
    return ends.groupBy("id").agg(F.count("*").alias("degree"))
