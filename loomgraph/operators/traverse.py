"""Questions answered by walking the graph."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import fixed, text
from loomgraph.operators.analyze import with_degree
from loomgraph.operators.assemble import degrees, symmetric
from loomgraph.session import cut, hint_if_small, reused


def incident(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Edges as seen from a node: (id, other, forward, relation, ...)."""
    rest = [c for c in edges.columns if c not in ("source", "target", "k1", "k2")]
    if directed:
        return edges.select(F.col("source").alias("id"), F.col("target").alias("other"), F.lit(True).alias("forward"), *rest)
    rows = symmetric(edges.select("source", "target", *rest))
    return rows.withColumn("forward", F.col("id") == F.col("source")).drop("source", "target")


# --- lookup -------------------------------------------------------------------


def folded(nodes: DataFrame) -> DataFrame:
    """Nodes with ``norm_label``, the folded label every lookup compares.

    A stored graph carries the column, so folding happens once, at build time.
    """
    if "norm_label" in nodes.columns:
        return nodes
    return nodes.withColumn("norm_label", text.query_norm("label"))


def _fold_name(name: str) -> tuple[str, str, str]:
    plain = name.rstrip("/\\")
    low = unicodedata.normalize("NFC", plain).casefold()
    return plain, low, low[:-2] if low.endswith("()") else low


def match_rank(name: str) -> Column:
    """0 exact id, 1 label, 2 label without call brackets, 3 part of the label; null otherwise."""
    q, full, short = _fold_name(name)
    bare = text.strip_call(F.col("norm_label"))
    rank = F.when(F.col("id") == q, 0).when(F.col("norm_label") == full, 1).when(bare == short, 2)
    return rank.when(F.contains(bare, F.lit(short)), 3) if short else rank


def find_nodes(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(lookup, id, match): for the place of each name its best match, ties in node order, from one scan."""
    best = []
    for name in names:
        match = match_rank(name)
        rank = F.when(match.isNotNull(), F.struct(match.alias("match"), F.col("ord")))
        best.append(F.min_by(F.struct(F.col("id"), match.alias("match")), rank))
    found = folded(nodes).agg(*[hit.alias(f"hit{k}") for k, hit in enumerate(best)])
    rows = F.array(*[F.struct(F.lit(k).alias("lookup"), F.col(f"hit{k}.id").alias("id"), F.col(f"hit{k}.match").alias("match")) for k in range(len(names))])
    return found.select(F.inline(rows)).where(F.col("match").isNotNull())


def find_node(nodes: DataFrame, name: str) -> DataFrame:
    """At most one row (id, match): the best match, ties in node order."""
    return find_nodes(nodes, [name]).select("id", "match")


def resolve_name(nodes: DataFrame, name: str) -> str | None:
    row = find_node(nodes, name).first()
    return row["id"] if row else None


# --- question search -----------------------------------------------------------


def question_scores(nodes: DataFrame, question: str) -> DataFrame:
    """(id, label, score, ord) of nodes the question's words touch.

    The words are few and known, so they are constants of the scan and rows
    that match none are filtered before scoring.
    """
    bare = text.strip_call(F.col("norm_label"))
    points, touched = F.lit(0.0), F.lit(False)
    for word in question_words(question):
        part = F.contains(F.col("n_bare"), F.lit(word))
        exact = (F.col("norm_label") == word) | (F.col("n_bare") == word)
        points = points + F.when(exact, fixed.EXACT_HIT).when(part, fixed.PARTIAL_HIT).otherwise(0.0)
        touched = touched | part | (F.col("norm_label") == word)
    return (
        folded(nodes)
        .select("id", "label", "ord", "norm_label", bare.alias("n_bare"))
        .where(touched)
        .select("id", "label", points.alias("score"), "ord")
    )


def question_words(question: str) -> list[str]:
    """Driver-side twin of ``text.question_tokens`` for a question typed by a user."""
    words = (w.lower() for w in re.findall(r"[a-zA-Z_][a-zA-Z0-9_]+", question))
    return [w for w in words if w not in fixed.QUESTION_STOP_WORDS]


@dataclass
class Subgraph:
    """The part of the graph a question is about."""

    nodes: DataFrame
    edges: DataFrame
    matched: DataFrame
    budget: int

    def truncated(self) -> bool:
        return self.nodes.count() >= self.budget


def direct_hits(nodes: DataFrame, question: str, budget: int = fixed.QUERY_BUDGET) -> DataFrame:
    """Best third of the budget, with its position as ``rank``."""
    top = question_scores(nodes, question).orderBy(F.desc("score"), "ord").limit(budget // 3)
    order = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ord", "id", "label", "score"))),
        lambda x, i: F.struct(i.alias("rank"), x["id"].alias("id"), x["label"].alias("label"), x["score"].alias("score")),
    )
    return top.agg(F.inline(order))


def question_nodes(nodes: DataFrame, edges: DataFrame, question: str, budget: int = fixed.QUERY_BUDGET) -> tuple[DataFrame, DataFrame]:
    """(hits, subgraph ids): hits plus neighbours, in hit order, until the budget is spent.

    A neighbour that is itself a hit still uses up budget.
    """
    hits = cut(direct_hits(nodes, question, budget))
    n_hits = hits.count()
    near = (
        incident(edges)
        .join(F.broadcast(hits.select("id", "rank")), "id")  # at most budget // 3 rows
        .groupBy(F.col("other").alias("id"))
        .agg(F.min("rank").alias("rank"))
    )
    near = near.join(nodes.select("id", "ord"), "id").orderBy("rank", "ord").limit(max(budget - n_hits, 1))
    return hits, cut(hits.select("id").unionByName(near.select("id")).distinct())


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )


def query(nodes: DataFrame, edges: DataFrame, question: str, budget: int = fixed.QUERY_BUDGET) -> Subgraph:
    hits, ids = question_nodes(nodes, edges, question, budget)
    return Subgraph(nodes.join(F.broadcast(ids), "id", "left_semi"), induced(edges, F.broadcast(ids)), hits, budget)


# --- neighbourhood ----------------------------------------------------------------


def neighbours_of(nodes: DataFrame, edges: DataFrame, node_id: str | Column, relation: str | None = None, directed: bool = False) -> DataFrame:
    """(node, label, file_type, source_file, direction, relation, confidence) around one node."""
    around = edges.where((F.col("source") == node_id) | (F.col("target") == node_id))
    rows = incident(around, directed).where(F.col("id") == node_id)
    if relation:
        rows = rows.where(F.col("relation") == relation)
    info = nodes.select(F.col("id").alias("other"), "label", "file_type", F.col("source_file").alias("node_file"), "ord")
    return rows.select("other", "forward", "relation", "confidence").join(info, "other").select(
        F.col("other").alias("node"),
        "label",
        "file_type",
        F.col("node_file").alias("source_file"),
        F.when(F.col("forward"), "out").otherwise("in").alias("direction"),
        F.coalesce("relation", F.lit("?")).alias("relation"),
        F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence"),
        "ord",
    )


def neighbors(nodes: DataFrame, edges: DataFrame, name: str, relation: str | None = None, directed: bool = False) -> DataFrame:
    found = resolve_name(nodes, name)
    node_id = F.lit(found) if found is not None else F.lit(None).cast("string")
    return neighbours_of(nodes, edges, node_id, relation, directed).select("node", "label", "relation", "confidence")


def connections(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = 30) -> DataFrame:
    """Neighbours by their own degree, strongest first."""
    near = cut(neighbours_of(nodes, edges, F.lit(node_id)))
    ids = hint_if_small(near.select(F.col("node").alias("id")).distinct(), near.count())
    weight = degrees(edges, ids).withColumnRenamed("id", "node")
    return near.join(weight, "node").orderBy(F.desc("degree"), "ord", "node").limit(limit).drop("ord")


def explain(nodes: DataFrame, edges: DataFrame, name: str, community_names: DataFrame | None = None, limit: int = 30) -> dict | None:
    """One node's own row plus its strongest connections."""
    node_id = resolve_name(nodes, name)
    if node_id is None:
        return None
    own = with_degree(nodes.where(F.col("id") == node_id), edges.where((F.col("source") == node_id) | (F.col("target") == node_id)))
    row = own.first().asDict()
    community = row.get("community")
    label = None
    if community_names is not None and community is not None:
        hit = community_names.where(F.col("cid") == community).select("label").first()
        label = hit["label"] if hit else None
    keys = ("id", "label", "file_type", "source_file", "source_location", "degree")
    return {
        **{k: row.get(k) for k in keys},
        "community": community,
        "community_label": label,
        "connections": [r.asDict() for r in connections(nodes, edges, node_id, limit).collect()],
    }


# --- breadth-first walks -----------------------------------------------------------


def reach(nodes: DataFrame, edges: DataFrame, start: str, max_depth: int = 4, relations: list[str] | None = None, directed: bool = False) -> DataFrame:
    """(id, depth, via) of everything within ``max_depth`` steps of ``start``.

    ``via`` is the relation of the edge that reached the node first: from the
    earliest parent in node order. Each level is materialised once; a level's
    rows only meet the edges of its own frontier.
    """
    walk = edges.select("source", "target", "relation")
    if relations is not None:
        walk = walk.where(F.col("relation").isin(relations))
    first = nodes.where(F.col("id") == start).select("id", "ord", F.lit(0).alias("depth"), F.lit("root").alias("via"))
    seen = frontier = cut(first)
    size = 1
    order = nodes.select("id", "ord")
    with reused(walk) as kept:  # each edge once; both its ends as it is read
        steps = incident(kept, directed).select("id", "other", "relation")
        for depth in range(1, max_depth + 1):
            step = (
                steps.join(hint_if_small(frontier.select("id", F.col("ord").alias("from_ord")), size), "id")
                .groupBy(F.col("other").alias("id"))
                .agg(F.min_by("relation", F.struct("from_ord", "relation")).alias("via"))
                .join(seen.select("id"), "id", "left_anti")
                .join(order, "id")
                .select("id", "ord", F.lit(depth).alias("depth"), "via")
            )
            frontier = cut(step)
            size = frontier.count()
            if not size:
                break
            seen = seen.unionByName(frontier)
    return seen


def affected(nodes: DataFrame, edges: DataFrame, name: str, max_depth: int = 4, directed: bool = False) -> DataFrame:
    """(node, label, depth, via, source_file): the blast radius of a node."""
    start = resolve_name(nodes, name) or ""
    hit = reach(nodes, edges, start, max_depth, fixed.AFFECTED_RELATIONS, directed)
    return (
        hit.where(F.col("depth") > 0)
        .join(nodes.select("id", "label", "source_file"), "id")
        .select(F.col("id").alias("node"), "label", "depth", "via", "source_file", "ord")
    )


def shortest_path(edges: DataFrame, start: str, goal: str, max_hops: int = 6) -> list[str] | None:
    """Node ids of the shortest path, the smallest in id order among equals.

    The walk grows from both ends, always the smaller frontier, so a hub next
    to one end is not expanded when the other end can get there first. A row
    carries its own path, at most ``max_hops`` ids.
    """
    if start == goal:
        return [start]
    walk = edges.select("source", "target").where(F.col("source") != F.col("target"))
    with reused(walk) as kept:
        return _meet(incident(kept).select("id", "other"), start, goal, max_hops)


def _meet(walk: DataFrame, start: str, goal: str, max_hops: int) -> list[str] | None:
    spark = walk.sparkSession
    sides = []
    for node in (start, goal):
        rows = spark.range(1).select(F.lit(node).alias("id"), F.array(F.lit(node)).alias("trail"))
        sides.append({"seen": rows, "front": rows, "size": 1, "depth": 0})
    while sides[0]["depth"] + sides[1]["depth"] < max_hops:
        grow = 0 if sides[0]["size"] <= sides[1]["size"] else 1
        side, other = sides[grow], sides[1 - grow]
        trail = F.array_append("trail", F.col("other")) if grow == 0 else F.array_prepend("trail", F.col("other"))
        step = (
            walk.join(hint_if_small(side["front"], side["size"]), "id")
            .select(F.col("other").alias("id"), trail.alias("trail"))
            .groupBy("id")
            .agg(F.min("trail").alias("trail"))
            .join(side["seen"].select("id"), "id", "left_anti")
        )
        side["front"] = cut(step)
        side["size"] = side["front"].count()
        side["depth"] += 1
        if not side["size"]:
            return None
        ahead, back = (side["front"], other["front"]) if grow == 0 else (other["front"], side["front"])
        met = ahead.select("id", F.col("trail").alias("head")).join(back.select("id", F.col("trail").alias("tail")), "id")
        full = F.concat("head", F.slice("tail", F.lit(2), F.greatest(F.size("tail") - 1, F.lit(0))))
        best = met.agg(F.min(full).alias("path")).first()["path"]
        if best is not None:
            return list(best)
        side["seen"] = side["seen"].unionByName(side["front"])
    return None


def path(nodes: DataFrame, edges: DataFrame, a: str, b: str, max_hops: int = 6) -> DataFrame | None:
    """Hops (hop, source, target, labels, relation, confidence) between two named nodes."""
    start, goal = resolve_name(nodes, a), resolve_name(nodes, b)
    if start is None or goal is None:
        return None
    ids = shortest_path(edges, start, goal, max_hops)
    return None if ids is None else path_hops(nodes, edges, ids)


def path_hops(nodes: DataFrame, edges: DataFrame, ids: list[str]) -> DataFrame:
    """Decorate a path's consecutive pairs with labels and edge attributes."""
    spark = nodes.sparkSession
    pairs = [(i, u, v, min(u, v), max(u, v)) for i, (u, v) in enumerate(zip(ids, ids[1:]))]
    hops = F.broadcast(spark.createDataFrame(pairs, "hop int, source string, target string, k1 string, k2 string"))
    info = edges.select(
        F.least("source", "target").alias("k1"), F.greatest("source", "target").alias("k2"), "relation", "confidence"
    )
    labels = nodes.select("id", "label").where(F.col("id").isin(ids))
    return (
        info.join(hops, ["k1", "k2"])
        .join(labels.select(F.col("id").alias("source"), F.col("label").alias("source_label")), "source")
        .join(labels.select(F.col("id").alias("target"), F.col("label").alias("target_label")), "target")
        .select("hop", "source", "target", "source_label", "target_label", "relation", "confidence")
    )
