"""Conservative resolution: only names with exactly one candidate become edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import fixed, text
from loomgraph.operators.assemble import pair_keys


def resolvable(nodes: DataFrame) -> DataFrame:
    """Code nodes that can be the target of a call."""
    label = F.btrim(F.col("label"))
    is_file = F.lit(False)
    for tail in fixed.SYMBOL_FILE_SUFFIXES:
        is_file = is_file | label.endswith(tail)
    return nodes.where((F.col("file_type") == "code") & (label != "") & ~is_file).withColumn(
        "key", text.callable_key("label")
    ).where(F.col("key") != "")


def label_index(nodes: DataFrame) -> DataFrame:
    """key -> (node_id, candidates); node_id is only meaningful when candidates = 1."""
    return resolvable(nodes).groupBy("key").agg(F.min("id").alias("node_id"), F.count("*").alias("candidates"))


def resolve_calls(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Raw calls whose target is unambiguous, as edge records.

    Call rows that repeat (caller, name) collapse before the lookup, so a
    popular callee does not carry its repeats through the join. A name that has
    no candidate under its bare key is looked up once more as written.
    """
    name = F.btrim("name")
    sites = (
        calls.where((name != "") & (F.col("caller") != ""))
        .groupBy("caller", name.alias("name"))
        .agg(F.min_by(F.struct("location", "source_file", "fragment_key", "pos"), F.struct("fragment_key", "pos")).alias("site"))
        .select("caller", "name", "site.*")
        .withColumns({"key": text.callable_key("name"), "as_written": F.lower("name")})
    )
    index = label_index(nodes)
    first = sites.join(index, "key", "left")
    second = index.select(F.col("key").alias("as_written"), F.col("node_id").alias("id2"), F.col("candidates").alias("n2"))
    retry = (
        first.where(F.col("candidates").isNull() & (F.col("key") != F.col("as_written")))
        .join(second, "as_written")
        .withColumns({"node_id": F.col("id2"), "candidates": F.col("n2")})
        .drop("id2", "n2")
    )
    hits = first.where(F.col("candidates").isNotNull()).unionByName(retry)
    return hits.where((F.col("candidates") == 1) & (F.col("node_id") != F.col("caller"))).select(
        F.col("caller").alias("source"),
        F.col("node_id").alias("target"),
        F.lit("calls").alias("relation"),
        F.lit("INFERRED").alias("confidence"),
        F.lit(fixed.CALL_SCORE).alias("confidence_score"),
        "source_file",
        F.col("location").alias("source_location"),
        F.lit(fixed.CALL_WEIGHT).alias("weight"),
        "fragment_key",
        "pos",
    )


def new_pairs_only(candidates: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """First candidate per pair that no existing edge occupies, whatever its relation."""
    k1, k2 = pair_keys(directed)
    best = (
        candidates.withColumns({"k1": k1, "k2": k2})
        .groupBy("k1", "k2")
        .agg(F.min_by(F.struct(*candidates.columns), F.struct("fragment_key", "pos")).alias("e"))
    )
    return best.join(edges.select("k1", "k2"), ["k1", "k2"], "left_anti").select("k1", "k2", "e.*")


def inferred_calls(nodes: DataFrame, edges: DataFrame, calls: DataFrame, directed: bool = False) -> DataFrame:
    """New ``calls`` edges between existing nodes."""
    ids = nodes.select("id")
    found = resolve_calls(nodes, calls)
    found = found.join(ids, found.source == ids.id, "left_semi")
    return new_pairs_only(found, edges, directed).withColumn("ord", F.struct("fragment_key", "pos")).drop("fragment_key", "pos")


def code_label_index(nodes: DataFrame) -> DataFrame:
    """Bare code label -> node id; a label two code nodes share resolves to nothing."""
    return (
        nodes.where(F.col("file_type") == "code")
        .groupBy(text.bare("label").alias("bare"))
        .agg(F.min("id").alias("node_id"), F.count("*").alias("n"))
        .where((F.col("bare") != "") & (F.col("n") == 1))
        .drop("n")
    )


def resolve_code_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Concept-to-code claims with ``node_id`` filled when the name is unambiguous."""
    key = F.lower(F.ltrim(F.rtrim(F.btrim("code_name"), F.lit("()")), F.lit(".")))
    known = nodes.select(F.col("id").alias("concept_id"), F.col("source_file").alias("concept_file"))
    return (
        links.withColumn("bare", key)
        .join(code_label_index(nodes), "bare", "left")
        .join(known, "concept_id", "left")
    )
