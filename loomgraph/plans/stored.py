"""A stored graph opened for questions. Answers are DataFrames; printing is left to the caller."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import traverse
from loomgraph.sources import graph_json


@dataclass(frozen=True)
class StoredGraph:
    """Nodes, edges and communities below one folder, with the direction the build gave them."""

    nodes: DataFrame
    edges: DataFrame
    communities: DataFrame
    directed: bool

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredGraph:
        nodes, edges = graph_json.read_graph(spark, path)
        meta = spark.read.schema("source_root string, directed boolean").json(f"{path}/meta").first()
        return cls(nodes, edges, spark.read.parquet(f"{path}/communities"), bool(meta and meta["directed"]))

    def hits(self, question: str, budget: int) -> DataFrame:
        """Nodes of a question's subgraph, direct matches first."""
        sub = traverse.query(self.nodes, self.edges, question, budget)
        ranks = sub.matched.select("id", "rank")
        return sub.nodes.join(ranks, "id", "left").select("rank", "label", "file_type", "source_file", "source_location").orderBy(F.col("rank").asc_nulls_last(), "label")

    def route(self, a: str, b: str, max_hops: int) -> DataFrame | None:
        hops = traverse.path(self.nodes, self.edges, a, b, max_hops)
        return None if hops is None else hops.select("hop", "source_label", "relation", "target_label", "confidence").orderBy("hop")

    def around(self, name: str) -> DataFrame:
        return traverse.neighbors(self.nodes, self.edges, name, directed=self.directed).select("label", "relation", "confidence").orderBy("label", "relation")

    def downstream(self, name: str, depth: int) -> DataFrame:
        hits = traverse.affected(self.nodes, self.edges, name, depth, directed=self.directed)
        return hits.select("depth", "label", "via").orderBy("depth", "label")
