"""The fragment gate: one error row per violation, a fragment with any is dropped whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.schema import CONFIDENCES, FILE_TYPES, REQUIRED_EDGE_FIELDS, REQUIRED_NODE_FIELDS


def _errors(df: DataFrame, section: str, when, message) -> DataFrame:
    return df.where(when).select("fragment_key", F.lit(section).alias("section"), "pos", message.alias("message"))


def fragment_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fragment_key, section, pos, message) for exploded node and edge records.

    Field checks are row predicates. The endpoint check needs the fragment's
    own ids: both endpoints of an edge are looked up in one join on
    (fragment_key, id), and fragments without any id are not checked.
    """
    shown = F.coalesce(F.concat(F.lit(" "), "id"), F.lit(""))
    field_checks = [
        F.when(
            F.col(f).isNull(),
            F.format_string(f"node %d%s: no {f}", F.col("pos"), shown),
        )
        for f in REQUIRED_NODE_FIELDS
    ]
    field_checks.append(
        F.when(
            ~F.col("file_type").isin(FILE_TYPES),
            F.format_string("node %d%s: unknown file_type %s", F.col("pos"), shown, F.col("file_type")),
        )
    )
    node_errors = nodes.select(
        "fragment_key", F.lit("nodes").alias("section"), "pos", F.explode(F.array_compact(F.array(*field_checks))).alias("message")
    )
    edge_checks = [
        F.when(F.col(f).isNull(), F.format_string(f"edge %d: no {f}", F.col("pos")))
        for f in REQUIRED_EDGE_FIELDS
    ]
    edge_checks.append(
        F.when(
            ~F.col("confidence").isin(CONFIDENCES),
            F.format_string("edge %d: unknown confidence %s", F.col("pos"), F.col("confidence")),
        )
    )
    edge_errors = edges.select(
        "fragment_key", F.lit("edges").alias("section"), "pos", F.explode(F.array_compact(F.array(*edge_checks))).alias("message")
    )
    return reduce(DataFrame.unionByName, [node_errors, edge_errors, _endpoint_errors(nodes, edges)])


def _endpoint_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.where(F.col("id").isNotNull()).groupBy("fragment_key", "id").agg(F.lit(1).alias("known"))
    has_ids = ids.select("fragment_key").distinct()
    ends = edges.select(
        "fragment_key",
        "pos",
        F.explode(
            F.array(
                F.struct(F.lit("source").alias("end"), F.col("source").alias("id")),
                F.struct(F.lit("target").alias("end"), F.col("target").alias("id")),
            )
        ).alias("e"),
    ).select("fragment_key", "pos", "e.*")
    missing = (
        ends.where(F.col("id").isNotNull())
        .join(ids, ["fragment_key", "id"], "left_anti")
        .join(has_ids, "fragment_key", "left_semi")
    )
    return missing.select(
        "fragment_key",
        F.lit("edges").alias("section"),
        "pos",
        F.format_string("edge %d: %s %s is no node of the fragment", "pos", "end", "id").alias("message"),
    )


def drop_invalid(nodes: DataFrame, edges: DataFrame, *others: DataFrame) -> tuple[DataFrame, ...]:
    """Remove every record of a fragment that has an error."""
    bad = fragment_errors(nodes, edges).select("fragment_key").distinct()
    return tuple(df.join(bad, "fragment_key", "left_anti") for df in (nodes, edges, *others))


def assert_valid(nodes: DataFrame, edges: DataFrame, shown: int = 20) -> None:
    """Raise with the first messages when any fragment is invalid."""
    errors = fragment_errors(nodes, edges)
    total = errors.count()
    if total:
        head = errors.orderBy("fragment_key", "section", "pos", "message").limit(shown).collect()
        lines = "\n".join(f"  - {r.message}" for r in head)
        raise ValueError(f"{total} violations in the fragments:\n{lines}")
