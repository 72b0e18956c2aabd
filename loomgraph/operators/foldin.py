"""Fold validated concept fragments into a built graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import fixed
from loomgraph.operators.assemble import pair_keys
from loomgraph.operators.resolve import resolve_code_links
from loomgraph.session import cut

_FIELDS = ["label", "file_type", "source_file", "source_location", "summary"]


def upsert_nodes(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Later non-empty values win; empty ones only fill gaps. Adds ``is_new``."""
    at = F.struct("fragment_key", "pos")
    latest = incoming.groupBy("id").agg(
        *[F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", at)).alias(f"new_{c}") for c in _FIELDS],
        F.min(at).alias("new_ord"),
    )
    rest = [c for c in nodes.columns if c not in _FIELDS + ["id", "ord"]]
    merged = nodes.withColumn("present", F.lit(True)).join(latest, "id", "full")
    ord_col = F.coalesce("ord", "new_ord") if dict(nodes.dtypes)["ord"] == dict(latest.dtypes)["new_ord"] else F.col("ord")
    return merged.select(
        "id",
        *[F.coalesce(f"new_{c}", c).alias(c) for c in _FIELDS],
        *rest,
        ord_col.alias("ord"),
        F.col("present").isNull().alias("is_new"),
    )


def fold_in(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, links: DataFrame, directed: bool = False):
    """(nodes, edges, stats): concepts added, their edges, and resolved code links.

    A pair that has an edge already keeps it. Fragments are read in order, each
    with its edges before its code links.
    """
    all_nodes = cut(upsert_nodes(nodes, new_nodes))
    resolved = cut(resolve_code_links(nodes, links))
    usable = (F.col("node_id").isNotNull()) & (F.col("node_id") != F.col("concept_id"))
    ids = all_nodes.select("id")
    as_edges = (
        resolved.where(usable)
        .drop("concept_file")
        .join(all_nodes.select(F.col("id").alias("concept_id"), F.col("source_file").alias("concept_file")), "concept_id")
        .select(
            F.col("concept_id").alias("source"),
            F.col("node_id").alias("target"),
            F.lit("references").alias("relation"),
            F.lit("INFERRED").alias("confidence"),
            F.lit(fixed.CALL_SCORE).alias("confidence_score"),
            F.col("concept_file").alias("source_file"),
            F.lit(None).cast("string").alias("source_location"),
            F.lit(fixed.CALL_WEIGHT).alias("weight"),
            "fragment_key",
            F.lit(1).alias("section"),
            "pos",
        )
    )
    k1, k2 = pair_keys(directed)
    candidates = new_edges.withColumn("section", F.lit(0)).unionByName(as_edges, allowMissingColumns=True)
    candidates = candidates.join(ids, candidates.source == ids.id, "left_semi").join(ids, candidates.target == ids.id, "left_semi")
    at = F.struct("fragment_key", "section", "pos")
    added = cut(
        candidates.withColumns({"k1": k1, "k2": k2})
        .groupBy("k1", "k2")
        .agg(F.min_by(F.struct(*candidates.columns), at).alias("e"))
        .join(edges.select("k1", "k2"), ["k1", "k2"], "left_anti")
        .select("k1", "k2", "e.*")
    )
    counts = added.agg(F.count_if(F.col("section") == 0).alias("concept_edges"), F.count_if(F.col("section") == 1).alias("code_links"))
    concepts = all_nodes.agg(F.count_if(F.col("is_new") & (F.col("file_type") == "concept")).alias("concepts"))
    total = resolved.agg(F.count("*").alias("links"))
    stats = concepts.crossJoin(counts).crossJoin(total).select(  # three single rows
        "concepts", "concept_edges", "code_links", (F.col("links") - F.col("code_links")).alias("unresolved")
    )
    extra = added.withColumn("ord", F.struct("fragment_key", "pos")).select(*[c for c in edges.columns if c in added.columns or c == "ord"])
    return all_nodes.drop("is_new"), edges.unionByName(extra, allowMissingColumns=True), stats
