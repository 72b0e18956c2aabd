"""Rankings over the finished graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import fixed, paths
from loomgraph.functions.ids import same_id
from loomgraph.operators.assemble import degrees, symmetric
from loomgraph.schema import CONFIDENCES
from loomgraph.session import cut, reused

#: Rows that a batch of sources may spread over the links of a graph.
FLOW_ROWS = 20_000_000


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


# --- predicates ---------------------------------------------------------------


def is_file_anchor() -> Column:
    """Synthetic hubs: the file itself, method stubs, callables nothing else touches."""
    label = F.col("label")
    return (label != "") & (
        ((F.col("source_file") != "") & (label == paths.basename("source_file")))
        | (label.startswith(".") & label.endswith("()"))
        | (label.endswith("()") & (F.col("degree") <= 1))
    )


def is_concept() -> Column:
    return F.col("file_type") == "concept"


def is_json_key() -> Column:
    return F.lower("source_file").endswith(".json") & F.lower(F.btrim("label")).isin(fixed.JSON_NOISE_LABELS)


def is_builtin_label() -> Column:
    return F.col("label").isin(fixed.BUILTIN_NOISE_LABELS)


def language_family(source_file: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGE_FAMILY.items() for x in kv])
    return F.try_element_at(table, F.lower(paths.suffix(source_file)))


def cross_language(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(language_family(a) != language_family(b), F.lit(False))


def confidence_rank(confidence: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.CONFIDENCE_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, confidence), F.lit(3))


# --- rankings --------------------------------------------------------------------


def god_nodes(nodes: DataFrame, edges: DataFrame, top_n: int = 10) -> DataFrame:
    """The best-connected real entities, ties in node order."""
    noise = is_file_anchor() | is_concept() | is_json_key() | is_builtin_label()
    return (
        with_degree(nodes, edges)
        .where(~F.coalesce(noise, F.lit(False)))
        .orderBy(F.desc("degree"), F.asc("ord"))
        .limit(top_n)
        .select("id", "label", "degree")
    )


def source_count(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("source_file") != "").agg(F.count_distinct("source_file").alias("n_sources"))


def surprising_connections(nodes: DataFrame, edges: DataFrame, membership: DataFrame | None = None, top_n: int = 5) -> DataFrame:
    """Edges the file layout does not explain, least certain first.

    With several sources: cross-file edges between communities of one language.
    With one source: the bridges with the highest betweenness.
    """
    several = nodes.where(F.col("source_file") != "").select("source_file").distinct().limit(2).count() > 1
    if not several:
        return bridge_edges(nodes, edges, top_n)
    return cross_file_connections(nodes, edges, membership, top_n)


def cross_file_connections(nodes: DataFrame, edges: DataFrame, membership: DataFrame | None, top_n: int | None = 5) -> DataFrame:
    ends = with_degree(nodes, edges).select("id", "label", "source_file", "degree")
    if membership is not None:
        ends = ends.join(membership.select(F.col("id").alias("member"), "cid"), same_id("id", "member"), "left").drop("member")
    else:
        ends = ends.withColumn("cid", F.lit(None).cast("long"))
    u = ends.select(*[F.col(c).alias(f"u_{c}") for c in ends.columns])
    v = ends.select(*[F.col(c).alias(f"v_{c}") for c in ends.columns if c != "degree"])
    crossing = (F.col("u_source_file") != "") & (F.col("v_source_file") != "") & (F.col("u_source_file") != F.col("v_source_file"))
    together = F.coalesce(F.col("u_cid") == F.col("v_cid"), F.lit(False))
    confidence = F.coalesce("confidence", F.lit("EXTRACTED"))
    rows = (
        edges.select("source", "target", "relation", confidence.alias("confidence"))
        .join(u, same_id("source", "u_id"))
        .join(v, same_id("target", "v_id"))
        .where(crossing & ~cross_language("u_source_file", "v_source_file") & ~together)
        .withColumn("rank", confidence_rank(F.col("confidence")))
    )
    if top_n is not None:
        rows = rows.orderBy("rank", F.desc("u_degree"), "source", "target").limit(top_n)
    return rows.select(
        "source",
        "target",
        F.col("u_label").alias("source_label"),
        F.col("v_label").alias("target_label"),
        "relation",
        "confidence",
        F.col("u_source_file").alias("from_file"),
        F.col("v_source_file").alias("to_file"),
    )


def knowledge_gaps(nodes: DataFrame, edges: DataFrame, top_n: int = 5, directed: bool = False) -> DataFrame:
    """Code nodes nothing points at."""
    ranked = with_degree(nodes, edges)
    lonely = F.col("degree") == 0
    if directed:
        ranked = ranked.join(edges.select(F.col("target").alias("id")).distinct().withColumn("has_in", F.lit(True)), "id", "left")
        lonely = F.col("has_in").isNull() & (F.col("degree") <= 1)
    return (
        ranked.where((F.col("file_type") == "code") & ~is_file_anchor() & lonely)
        .orderBy("ord")
        .limit(top_n)
        .select("id", "label", "source_file")
    )


def confidence_split(edges: DataFrame) -> DataFrame:
    """(confidence, n, percent) over the three tags, plus any other tag present."""
    domain = edges.sparkSession.createDataFrame([(c,) for c in CONFIDENCES], "confidence string")
    counts = edges.groupBy(F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")).agg(F.count("*").alias("n"))
    full = domain.join(counts, "confidence", "full").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = full.agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    return full.crossJoin(F.broadcast(total)).select(  # one aggregate row
        "confidence", "n", F.bround(F.col("n") / F.col("total") * 100, 0).cast("long").alias("percent")
    )


def inferred_average(edges: DataFrame) -> DataFrame:
    """One row: mean score of INFERRED edges, null when there are none."""
    return edges.where(F.col("confidence") == "INFERRED").agg(
        F.bround(F.avg(F.coalesce("confidence_score", F.lit(fixed.DEFAULT_REPORT_SCORE))), 2).alias("average_score")
    )



# --- edge betweenness ----------------------------------------------------------------


def _twins(named: DataFrame) -> DataFrame:
    """(id, twin, m): nodes with the same neighbours share a ``twin``, of which there are ``m``.

    Neighbour sets are told apart by their size and two 64-bit hash sums.
    """
    digest = [F.sum(F.xxhash64("other", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]
    signed = cut(named.groupBy("id").agg(F.count("*").alias("n"), *digest))
    kinds = signed.groupBy("n", "h0", "h1").agg(F.min("id").alias("first"), F.count("*").alias("m"))
    kinds = cut(kinds.withColumn("twin", F.monotonically_increasing_id()))
    return signed.join(kinds, ["n", "h0", "h1"]).select("id", "twin", F.col("m").cast("double").alias("m"))


def _batch_shares(sources: DataFrame, links: DataFrame) -> DataFrame | None:
    """(a, b, part): what the shortest paths of these sources add to the links between kinds of twins."""
    levels = [cut(sources.select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths"), F.lit(1.0).alias("mult"), "m"))]
    near = levels[0].where("m = 1").select("s", "id")  # other twins of a source are still to be reached
    while True:
        reached = (
            levels[-1]
            .join(links, "id")
            .groupBy("s", F.col("other").alias("id"))
            .agg(F.sum(F.col("paths") * F.col("mult")).alias("paths"), F.max("m_other").alias("m"))
            .join(near, ["s", "id"], "left_anti")
        )
        mult = F.col("m") - F.when(F.col("s") == F.col("id"), 1.0).otherwise(0.0)
        frontier = cut(reached.select("s", "id", "paths", mult.alias("mult"), "m"))
        if frontier.isEmpty():
            break
        near = frontier.select("s", "id").unionByName(levels[-1].select("s", "id") if len(levels) > 1 else near)
        levels.append(frontier)  # links lead one level up, down or nowhere: two levels are all that can be met again
    below = levels[-1].withColumn("dep", F.lit(0.0))
    shares = None
    for depth in range(len(levels) - 2, -1, -1):
        lower = below.select("s", F.col("id").alias("other"), F.col("paths").alias("paths2"), F.col("mult").alias("mult2"), "dep", F.col("m").alias("m2"))
        flow = (
            levels[depth]
            .join(links.select("id", "other"), "id")
            .join(lower, ["s", "other"])
            .select("s", "id", "other", "m", "m2", "mult2", (F.col("paths") / F.col("paths2") * (1 + F.col("dep"))).alias("share"))
        )
        with reused(flow) as share:
            # How many of the source's twins send this much over one link.
            senders = F.lit(1.0) if depth == 0 else F.when(F.col("other") == F.col("s"), F.col("m2") - 1).otherwise(F.col("ms"))
            of = share if depth == 0 else share.join(F.broadcast(sources.select(F.col("id").alias("s"), F.col("m").alias("ms"))), "s")  # a batch of sources
            ends = of.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
            part = cut(ends.agg(F.sum(F.col("share") * senders).alias("part")))
            shares = part if shares is None else shares.unionByName(part)
            back = share.groupBy("s", "id").agg(F.sum(F.col("share") * F.col("mult2")).alias("dep"))
            below = cut(levels[depth].join(back, ["s", "id"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0))))
    return None if shares is None else cut(shares.groupBy("a", "b").agg(F.sum("part").alias("part")))


def edge_betweenness(edges: DataFrame, flow_rows: int = FLOW_ROWS) -> DataFrame:
    """(k1, k2, score): share of all shortest paths that use an edge.

    Brandes' method as joins over a smaller graph: nodes with the same neighbours (the
    leaves of a hub, the suppliers of the same nations) are twins, and one of them stands
    for all with their number as weight. Sources are taken in batches of which the paths
    to every node and over every link stay within ``flow_rows``; a batch walks level by
    level, meets again only the two levels next to it, and leaves one sum for each link.
    """
    named = cut(symmetric(edges.where(F.col("source") != F.col("target")).select("source", "target")).distinct())
    kinds = cut(_twins(named))
    left, right = kinds.toDF("id", "a", "ma"), kinds.toDF("other", "b", "m_other")
    between = cut(named.join(left, "id").join(right, "other").select("id", "other", F.col("a"), "b", "m_other"))
    links = cut(between.select(F.col("a").alias("id"), F.col("b").alias("other"), "m_other").distinct())
    sources = cut(kinds.select(F.col("twin").alias("id"), "m").distinct())
    counts = sources.agg(F.count("*").alias("kinds"), F.sum("m").alias("n")).first()
    n, batches = counts["n"] or 0, max(1, math.ceil(counts["kinds"] * links.count() / flow_rows))
    total = None
    for k in range(batches):
        part = _batch_shares(cut(sources.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)), links)
        if part is not None:
            total = part if total is None else total.unionByName(part)
    if total is None:
        return edges.select(F.least("source", "target").alias("k1"), F.greatest("source", "target").alias("k2"), F.lit(0.0).alias("score"))
    scored = total.groupBy("a", "b").agg((F.sum("part") / (n * (n - 1))).alias("score"))
    pairs = between.where("id < other").select(F.col("id").alias("k1"), F.col("other").alias("k2"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(scored, ["a", "b"]).select("k1", "k2", "score")


def bridge_edges(nodes: DataFrame, edges: DataFrame, top_n: int = 5) -> DataFrame:
    labels = nodes.select("id", "label")
    keyed = edges.withColumns({"k1": F.least("source", "target"), "k2": F.greatest("source", "target")})
    top = (
        keyed.join(edge_betweenness(edges), ["k1", "k2"])
        .orderBy(F.desc(F.round("score", 9)), "k1", "k2")
        .limit(top_n)
    )
    return (
        top.join(labels.select(F.col("id").alias("source"), F.col("label").alias("source_label")), "source", "left")
        .join(labels.select(F.col("id").alias("target"), F.col("label").alias("target_label")), "target", "left")
        .select(
            "source",
            "target",
            "source_label",
            "target_label",
            "relation",
            F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"),
            F.bround("score", 3).alias("score"),
        )
    )
