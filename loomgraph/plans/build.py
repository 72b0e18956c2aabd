"""Corpus to graph: detect, extract, gate, assemble, resolve, merge, enrich, cluster, report.

Three tables are written on the way because later stages read them more than
once: fragment records, the graph, and its communities.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import (
    assemble,
    classify,
    community,
    dedupe,
    extract_code,
    extract_manifest,
    extract_markdown,
    foldin,
    resolve,
    semantic,
    validate,
)
from loomgraph.plans import report as report_text
from loomgraph.session import cut
from loomgraph.sources import files as file_source
from loomgraph.sources import fragment_store, graph_json
from loomgraph.sources.fragment_store import RECORDS


@dataclass
class BuildResult:
    root: str
    out: str
    nodes: int = 0
    edges: int = 0
    communities: int = 0
    cached_files: int = 0
    extracted_files: int = 0
    inferred_edges: int = 0
    merges: int = 0
    semantic: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)
    report: str = ""


def extract_records(files: DataFrame) -> dict[str, DataFrame]:
    """All structural records of ``files(path, content)``, one fragment per file and manifest."""
    code = extract_code.extract_code(files, stored=True)
    md_nodes, md_edges = extract_markdown.extract_markdown(extract_markdown.markdown_files(files))
    mf_nodes, mf_edges = extract_manifest.extract_manifests(files)
    return {
        "nodes": code["nodes"].unionByName(md_nodes).unionByName(mf_nodes),
        "edges": code["edges"].unionByName(md_edges).unionByName(mf_edges),
        "calls": code["calls"],
        "definitions": code["definitions"],
        "errors": code["errors"],
    }


def refresh_fragments(spark: SparkSession, files: DataFrame, store: str, update: bool) -> tuple[dict[str, DataFrame], int, int]:
    """(records, reused files, extracted files): extract what is new or changed and add it to the store.

    A build from scratch reuses nothing and leaves no older version behind.
    """
    version, reused, extracted = fragment_store.refresh(spark, files, store, extract_records, update)
    if not update:
        fragment_store.expire(spark, store)
    return fragment_store.read(spark, store, version), reused, extracted


def stored_replies(spark: SparkSession, path: str) -> DataFrame | None:
    """Model replies of earlier builds, by the hash of what was asked."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if fs.exists(folder) else None


def graph_from_records(records: dict[str, DataFrame], directed: bool = False) -> tuple[DataFrame, DataFrame, int, int]:
    """(nodes, edges, inferred, merges): the structural graph of validated fragments."""
    names = [n for n in RECORDS if n in records]
    passed = dict(zip(names, validate.drop_invalid(*[records[n] for n in names])))
    nodes, edges = assemble.assemble(passed["nodes"], passed["edges"], directed)
    nodes = cut(assemble.attach_definitions(nodes, passed["definitions"]) if "definitions" in passed else nodes)
    edges = cut(edges)
    inferred = 0
    if "calls" in passed:
        added = cut(resolve.inferred_calls(nodes, edges, passed["calls"], directed))
        inferred = added.count()
        edges = edges.unionByName(added.select(*edges.columns))
    nodes, edges, merges = dedupe.merge_duplicates(nodes, edges, directed)
    return cut(nodes), cut(edges), inferred, merges.count()


def build(
    spark: SparkSession,
    root: str,
    out: str,
    *,
    update: bool = False,
    directed: bool = False,
    write_report: bool = True,
    resolution: float = 1.0,
    model: Callable[[str], str] | None = None,
    extra_excludes: list[str] | None = None,
) -> BuildResult:
    """Build the graph of a folder. ``model`` enables the concept pass."""
    result = BuildResult(root=root, out=out)
    clock = time.perf_counter()

    def mark(stage: str) -> None:
        nonlocal clock
        now = time.perf_counter()
        result.timings[stage], clock = round(now - clock, 2), now

    known = fragment_store.latest_files(spark, f"{out}/fragments") if update else None
    found = cut(file_source.detect(spark, root, extra_excludes, known))
    health = classify.corpus_health(found).first().asDict()
    skipped = found.where(F.col("status") == "sensitive").count()
    mark("detect")
    readable = F.coalesce(F.col("file_type").isin("code", "document", "paper"), F.lit(False)) & (F.col("status") == "kept")
    manifest = (F.col("status") != "sensitive") & file_source.is_manifest("rel")
    usable = found.where((readable | manifest) & F.col("hash").isNotNull())
    records, result.cached_files, result.extracted_files = refresh_fragments(spark, usable, f"{out}/fragments", update)
    mark("extract")
    nodes, edges, result.inferred_edges, result.merges = graph_from_records(records, directed)
    mark("build")
    if model is not None:
        # Replies are known by what was asked, so unchanged documents are read for them after all.
        docs = found.where(F.col("file_type").isin("document", "paper"))
        unread = file_source.read_contents(docs.where("content is null").drop("content"), root, F.lit(True))
        docs = docs.where("content is not null").unionByName(unread).select("path", "content")
        known = stored_replies(spark, f"{out}/replies") if update else None
        replies = cut(semantic.ask_model(docs, model, known))
        replies.where("reply is not null").select("hash", "reply").write.mode("overwrite").parquet(f"{out}/replies")
        parts = semantic.fragments(replies)
        checked = validate.drop_invalid(parts["nodes"], parts["edges"], parts["links"])
        nodes, edges, stats = foldin.fold_in(nodes, edges, *checked, directed=directed)
        nodes, edges = cut(nodes), cut(edges)
        result.semantic = stats.first().asDict()
    mark("semantic")
    membership = cut(community.cluster(nodes, edges, resolution))
    named = cut(community.communities(nodes, edges, membership))
    mark("cluster")
    final = text_ready(nodes).join(membership.withColumnRenamed("cid", "community"), "id", "left")
    graph_json.write_graph(final, edges, out, named)
    spark.createDataFrame([(root, directed)], "source_root string, directed boolean").write.mode("overwrite").json(f"{out}/meta")
    stored_nodes, stored_edges = graph_json.read_graph(spark, out)
    result.nodes, result.edges, result.communities = stored_nodes.count(), stored_edges.count(), named.count()
    mark("write")
    if write_report:
        corpus = spark.createDataFrame([(health["total_files"], health["total_words"], skipped)], "files long, words long, secrets long")
        result.report = report_text.text(report_text.rows(stored_nodes, stored_edges, membership, named, corpus), root)
        spark.createDataFrame([(result.report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    mark("report")
    return result


def text_ready(nodes: DataFrame) -> DataFrame:
    """Store the folded label, so lookups never fold at query time."""
    return nodes.withColumn("norm_label", text.query_norm("label"))


__all__ = ["BuildResult", "build", "extract_records", "graph_from_records", "refresh_fragments"]
