"""Graph interchange: stored tables for work, node-link JSON for other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.schema import EDGE_FIELDS, NODE_FIELDS

NODE_COLUMNS = [f.name for f in NODE_FIELDS] + ["defines", "community"]
EDGE_COLUMNS = [f.name for f in EDGE_FIELDS]


def _json_row(df: DataFrame, columns: list[str]) -> Column:
    present = [c for c in columns if c in df.columns]
    return F.to_json(F.struct(*present))  # absent values are left out


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, communities: DataFrame | None = None) -> None:
    """The graph as parquet tables: what every later query reads."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    if communities is not None:
        communities.write.mode("overwrite").parquet(f"{path}/communities")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def node_link_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, id, json): one JSON object per node and per edge, nulls left out."""
    links = edges.withColumn("id", F.concat_ws(" ", "source", "target"))
    return nodes.select(F.lit("nodes").alias("section"), "id", _json_row(nodes, NODE_COLUMNS).alias("json")).unionByName(
        links.select(F.lit("links").alias("section"), "id", _json_row(edges, EDGE_COLUMNS).alias("json"))
    )


def drawing_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, json): what a viewer draws, absent values left out."""
    shown = [c for c in ("id", "label", "file_type", "source_file", "community") if c in nodes.columns]
    points = nodes.select(F.lit("nodes").alias("section"), F.to_json(F.struct(*shown)).alias("json"))
    return points.unionByName(edges.select(F.lit("links").alias("section"), F.to_json(F.struct("source", "target", "relation", "confidence")).alias("json")))


def export_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Line-delimited node-link export: ``nodes/*.json`` and ``links/*.json``, written by the executors."""
    rows = node_link_rows(nodes, edges)
    rows.select("section", F.col("json").alias("value")).write.mode("overwrite").partitionBy("section").text(path)


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A single node-link document; edges may be spelled ``edges`` or ``links``."""
    doc = spark.read.option("multiLine", "true").json(path)
    spelled = [c for c in ("edges", "links") if c in doc.columns]
    edges = doc.select(F.inline(spelled[0]))
    nodes = doc.select(F.posexplode("nodes").alias("ord", "n")).select("n.*", F.col("ord").cast("long").alias("ord"))
    for name, field in [(f.name, f) for f in NODE_FIELDS if f.name not in nodes.columns]:
        nodes = nodes.withColumn(name, F.lit(None).cast(field.dataType))
    for name, field in [(f.name, f) for f in EDGE_FIELDS if f.name not in edges.columns]:
        edges = edges.withColumn(name, F.lit(None).cast(field.dataType))
    return nodes, edges.withColumns({"k1": F.least("source", "target"), "k2": F.greatest("source", "target")})


def import_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read back ``export_node_link``."""
    from loomgraph.schema import EDGE, NODE

    nodes = spark.read.schema(NODE.add("community", "long").add("defines", "string")).json(f"{path}/section=nodes")
    edges = spark.read.schema(EDGE).json(f"{path}/section=links")
    return nodes, edges.withColumns({"k1": F.least("source", "target"), "k2": F.greatest("source", "target")})
