"""What a build found, as rows of (topic, place, line); only top lists and totals are printed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators import analyze

TOPICS = ["corpus", "size", "evidence", "most connected", "communities", "unexpected links", "nothing points here"]
#: Largest communities that are listed; the total is given.
LISTED = 20


def _lines(df: DataFrame, topic: str, line: Column, *order: Column) -> DataFrame:
    """Rows of one topic; ``df`` is a top list or a few totals."""
    place = F.row_number().over(Window.orderBy(*order)) if order else F.lit(1)
    return df.select(F.lit(topic).alias("topic"), place.alias("place"), line.alias("line"))


def rows(nodes: DataFrame, edges: DataFrame, membership: DataFrame, named: DataFrame, corpus: DataFrame) -> DataFrame:
    """(topic, place, line). ``corpus`` has one row: files, words, secrets."""
    size = nodes.agg(F.count("*").alias("n")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("e")))).crossJoin(F.broadcast(named.agg(F.count("*").alias("c"))))
    link = F.concat_ws(" ", "source_label", "relation", "target_label")
    largest = named.orderBy("cid").limit(LISTED)
    parts = [
        _lines(corpus, TOPICS[0], F.format_string("%d files with %d words; %d files look secret and were not read", "files", "words", "secrets")),
        _lines(size, TOPICS[1], F.format_string("nodes %d, edges %d, communities %d", "n", "e", "c")),
        _lines(analyze.confidence_split(edges), TOPICS[2], F.concat_ws(" ", F.lower("confidence"), F.concat(F.col("percent").cast("string"), F.lit("%"))), F.col("confidence")),
        _lines(analyze.god_nodes(nodes, edges), TOPICS[3], F.format_string("%s: %d", "label", "degree"), F.desc("degree"), F.col("label")),
        _lines(largest, TOPICS[4], F.format_string("%s: %d nodes, cohesion %.3f", "label", "size", "cohesion"), F.col("cid")),
        _lines(analyze.surprising_connections(nodes, edges, membership), TOPICS[5], F.concat_ws(", ", link, F.lower("confidence")), F.col("source_label"), F.col("target_label")),
        _lines(analyze.knowledge_gaps(nodes, edges), TOPICS[6], F.concat_ws(" in ", "label", "source_file"), F.col("label")),
    ]
    return reduce(DataFrame.unionByName, parts)


def text(report: DataFrame, root: str) -> str:
    """The rows as plain text; their number is bounded by the lists."""
    found: dict[str, list[str]] = {}
    for r in report.orderBy("topic", "place").collect():
        found.setdefault(r["topic"], []).append(r["line"])
    body = [f"{topic}\n" + "\n".join(f"  {line}" for line in found.get(topic, ["none"])) for topic in TOPICS]
    return "\n\n".join([f"loomgraph: {root}", *body]) + "\n"
