"""Queries over the star graph: degree, ranking, lookup, walks, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import fixed
from loomgraph.operators import analyze, assemble, community, leiden, traverse
from loomgraph.plans.registry import query
from loomgraph.session import cut
from loomgraph.sources.tables import (
    STAR_SQL,
    TRADE_SQL,
    star_edges,
    star_membership,
    star_nodes,
    trade_edges,
)

NOISE = ", ".join(f"'{x}'" for x in fixed.BUILTIN_NOISE_LABELS)
ANCHOR_SQL = (
    "(label <> '' AND ((source_file <> '' AND label = regexp_replace(source_file, '^.*/', '')) "
    "OR (label LIKE '.%' AND label LIKE '%()') OR (label LIKE '%()' AND coalesce(degree, 0) <= 1)))"
)
FAMILY_SQL = "CASE WHEN {0} LIKE '%.py' THEN 'python' WHEN {0} LIKE '%.go' THEN 'go' END"


@query("degree", f"WITH {STAR_SQL} SELECT id, degree FROM deg")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.degrees(star_edges(spark, sf_dir))


@query(
    "god_nodes",
    f"""WITH {STAR_SQL} SELECT id, label, CAST(coalesce(degree, 0) AS BIGINT) AS degree FROM nodes LEFT JOIN deg USING (id)
    WHERE NOT {ANCHOR_SQL} AND file_type <> 'concept' AND label NOT IN ({NOISE})
    ORDER BY degree DESC, ord LIMIT 10""",
)
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.god_nodes(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))


@query(
    "node_noise_flags",
    f"""WITH {STAR_SQL} SELECT id, {ANCHOR_SQL} AS file_anchor, file_type = 'concept' AS concept,
    label IN ({NOISE}) AS builtin FROM nodes LEFT JOIN deg USING (id)""",
)
def node_noise_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = analyze.with_degree(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))
    return ranked.select(
        "id",
        analyze.is_file_anchor().alias("file_anchor"),
        analyze.is_concept().alias("concept"),
        analyze.is_builtin_label().alias("builtin"),
    )


@query(
    "knowledge_gaps",
    f"""WITH {STAR_SQL}, doubtful AS (SELECT * FROM edges WHERE confidence = 'AMBIGUOUS'),
    touched AS (SELECT source AS id FROM doubtful UNION SELECT target FROM doubtful)
    SELECT id, label, source_file FROM nodes WHERE file_type = 'code' AND label NOT LIKE '%()'
    AND id NOT IN (SELECT id FROM touched) ORDER BY ord LIMIT 5""",
)
def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubtful = star_edges(spark, sf_dir).where(F.col("confidence") == "AMBIGUOUS")
    return analyze.knowledge_gaps(star_nodes(spark, sf_dir), doubtful)


@query(
    "confidence_split",
    f"""WITH {STAR_SQL}, d AS (SELECT unnest(['EXTRACTED', 'INFERRED', 'AMBIGUOUS']) AS confidence),
    c AS (SELECT confidence, count(*) AS n FROM edges GROUP BY confidence)
    SELECT d.confidence, coalesce(n, 0) AS n,
    CAST(round_even(coalesce(n, 0) / (SELECT CAST(sum(n) AS DOUBLE) FROM c) * 100, 0) AS BIGINT) AS percent
    FROM d LEFT JOIN c ON d.confidence = c.confidence""",
)
def confidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.confidence_split(star_edges(spark, sf_dir))


@query(
    "inferred_average",
    f"WITH {STAR_SQL} SELECT round_even(avg(coalesce(confidence_score, 0.5)), 2) AS average_score FROM edges WHERE confidence = 'INFERRED'",
)
def inferred_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.inferred_average(star_edges(spark, sf_dir))


@query("source_count", f"WITH {STAR_SQL} SELECT count(DISTINCT source_file) AS n_sources FROM nodes WHERE source_file <> ''")
def source_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.source_count(star_nodes(spark, sf_dir))


@query("file_type_counts", f"WITH {STAR_SQL} SELECT file_type, count(*) AS n FROM nodes GROUP BY file_type")
def file_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_nodes(spark, sf_dir).groupBy("file_type").agg(F.count("*").alias("n"))


SURPRISE_SQL = f"""WITH {STAR_SQL},
ends AS (SELECT nodes.id, label, source_file, coalesce(degree, 0) AS degree, cid,
         {FAMILY_SQL.format('source_file')} AS family FROM nodes LEFT JOIN deg USING (id) LEFT JOIN membership USING (id)),
found AS (SELECT e.source, e.target, u.label AS source_label, v.label AS target_label, relation, confidence,
          u.source_file AS from_file, v.source_file AS to_file, u.degree,
          CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 WHEN 'EXTRACTED' THEN 2 ELSE 3 END AS rank
   FROM edges e JOIN ends u ON e.source = u.id JOIN ends v ON e.target = v.id
   WHERE u.source_file <> v.source_file AND NOT coalesce(u.family <> v.family, FALSE) AND NOT coalesce(u.cid = v.cid, FALSE))
"""


@query(
    "surprising_connections",
    SURPRISE_SQL + "SELECT * EXCLUDE (degree, rank) FROM found ORDER BY rank, degree DESC, source, target LIMIT 5",
)
def surprising_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = star_nodes(spark, sf_dir), star_edges(spark, sf_dir)
    return analyze.surprising_connections(nodes, edges, star_membership(spark, sf_dir))


@query("cross_file_connections", SURPRISE_SQL + "SELECT * EXCLUDE (degree, rank) FROM found")
def cross_file_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = star_nodes(spark, sf_dir), star_edges(spark, sf_dir)
    return analyze.cross_file_connections(nodes, edges, star_membership(spark, sf_dir), top_n=None)


BETWEENNESS_SQL = f"""WITH {TRADE_SQL},
adj AS (SELECT source AS a, target AS b FROM trade UNION SELECT target, source FROM trade),
v AS (SELECT DISTINCT a AS s FROM adj),
d0 AS (SELECT s, s AS t, 0 AS d, CAST(1 AS DOUBLE) AS n FROM v),
d1 AS (SELECT a AS s, b AS t, 1 AS d, CAST(1 AS DOUBLE) AS n FROM adj),
u1 AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1),
d2 AS (SELECT x.s, b AS t, 2 AS d, sum(n) AS n FROM d1 x JOIN adj ON x.t = a
       WHERE NOT EXISTS (SELECT 1 FROM u1 k WHERE k.s = x.s AND k.t = b) GROUP BY x.s, b),
u2 AS (SELECT * FROM u1 UNION ALL SELECT * FROM d2),
d3 AS (SELECT x.s, b AS t, 3 AS d, sum(n) AS n FROM d2 x JOIN adj ON x.t = a
       WHERE NOT EXISTS (SELECT 1 FROM u2 k WHERE k.s = x.s AND k.t = b) GROUP BY x.s, b),
u3 AS (SELECT * FROM u2 UNION ALL SELECT * FROM d3),
d4 AS (SELECT x.s, b AS t, 4 AS d, sum(n) AS n FROM d3 x JOIN adj ON x.t = a
       WHERE NOT EXISTS (SELECT 1 FROM u3 k WHERE k.s = x.s AND k.t = b) GROUP BY x.s, b),
sp AS (SELECT * FROM u3 UNION ALL SELECT * FROM d4),
score AS (SELECT least(a, b) AS k1, greatest(a, b) AS k2,
          sum(l.n * r.n / f.n) / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)) AS score
   FROM adj JOIN sp l ON l.t = a JOIN sp r ON r.s = b JOIN sp f ON f.s = l.s AND f.t = r.t AND f.d = l.d + 1 + r.d
   GROUP BY 1, 2)
"""


@query("edge_betweenness", BETWEENNESS_SQL + "SELECT k1, k2, round(score, 9) AS score FROM score")
def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = analyze.edge_betweenness(trade_edges(spark, sf_dir))
    return scored.select("k1", "k2", F.round("score", 9).alias("score"))


@query(
    "bridge_edges",
    BETWEENNESS_SQL
    + """SELECT k2 AS source, k1 AS target, s_name AS source_label, n_name AS target_label, 'calls' AS relation,
    'EXTRACTED' AS confidence, round_even(score, 3) AS score
    FROM score JOIN supplier ON k2 = 'supplier_' || s_suppkey JOIN nation ON k1 = 'nation_' || n_nationkey
    ORDER BY round(score.score, 9) DESC, k1, k2 LIMIT 5""",
)
def bridge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze.bridge_edges(star_nodes(spark, sf_dir), trade_edges(spark, sf_dir))


# --- lookup and walks -----------------------------------------------------------

LOOKUPS = ["customer_7", "ORDER_12()", "Order_31", "old bolt", "#000000042", "Nation_3/", "no such thing"]


def _lookup_sql() -> str:
    arms = []
    for i, name in enumerate(LOOKUPS):
        q = name.rstrip("/\\")
        low = q.lower()
        short = low[:-2] if low.endswith("()") else low
        arms.append(
            f"(SELECT {i} AS lookup, id, match FROM (SELECT id, ord, CASE WHEN id = '{q}' THEN 0 WHEN lower(label) = '{low}' THEN 1 "
            f"WHEN regexp_replace(lower(label), '\\(\\)$', '') = '{short}' THEN 2 "
            f"WHEN contains(regexp_replace(lower(label), '\\(\\)$', ''), '{short}') THEN 3 END AS match FROM nodes) "
            f"WHERE match IS NOT NULL ORDER BY match, ord LIMIT 1)"
        )
    return f"WITH {STAR_SQL} " + " UNION ALL ".join(arms)


@query("find_node", _lookup_sql())
def find_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.find_nodes(star_nodes(spark, sf_dir), LOOKUPS)


QUESTION = "how does the old bolt connect to Nation_4 and the customer"
_BARE = "regexp_replace(lower(label), '\\(\\)$', '')"
SCORE_SQL = f"""scored AS (
  SELECT id, label, ord, sum(CASE WHEN lower(label) = t OR {_BARE} = t THEN 5.0 WHEN contains({_BARE}, t) THEN 2.0 ELSE 0.0 END) AS score
  FROM nodes, (SELECT unnest(['old', 'bolt', 'connect', 'nation_4', 'customer']) AS t) GROUP BY id, label, ord)"""


@query("question_scores", f"WITH {STAR_SQL}, {SCORE_SQL} SELECT id, label, CAST(score AS DOUBLE) AS score FROM scored WHERE score > 0")
def question_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.question_scores(star_nodes(spark, sf_dir), QUESTION).drop("ord")


HITS_SQL = f"""WITH {STAR_SQL}, {SCORE_SQL},
hits AS (SELECT id, label, score, row_number() OVER (ORDER BY score DESC, ord) - 1 AS rank FROM scored WHERE score > 0
         ORDER BY score DESC, ord LIMIT 20),
near AS (SELECT other AS id, min(rank) AS rank FROM sym JOIN hits USING (id) GROUP BY other),
extra AS (SELECT near.id FROM near JOIN nodes ON near.id = nodes.id ORDER BY rank, ord
          LIMIT (SELECT 60 - count(*) FROM hits)),
picked AS (SELECT id FROM hits UNION SELECT id FROM extra)
"""


@query("question_hits", HITS_SQL + "SELECT id, label, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM hits")
def question_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.direct_hits(star_nodes(spark, sf_dir), QUESTION)


@query("question_subgraph_nodes", HITS_SQL + "SELECT id, label, file_type, source_file FROM nodes WHERE id IN (SELECT id FROM picked)")
def question_subgraph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = traverse.query(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), QUESTION)
    return sub.nodes.select("id", "label", "file_type", "source_file")


@query(
    "question_subgraph_edges",
    HITS_SQL
    + "SELECT source, target, relation, confidence FROM edges WHERE source IN (SELECT id FROM picked) AND target IN (SELECT id FROM picked)",
)
def question_subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = traverse.query(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), QUESTION)
    return sub.edges.select("source", "target", "relation", "confidence")


@query(
    "explain_connections",
    f"""WITH {STAR_SQL} SELECT other AS node, n.label, n.file_type, n.source_file,
    CASE WHEN forward THEN 'out' ELSE 'in' END AS direction, relation, confidence, degree
    FROM sym JOIN nodes n ON other = n.id JOIN deg ON deg.id = other WHERE sym.id = 'nation_7'
    ORDER BY degree DESC, ord, node LIMIT 30""",
)
def explain_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.connections(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), "nation_7")


@query(
    "neighbors",
    f"""WITH {STAR_SQL} SELECT other AS node, n.label, relation, confidence FROM sym JOIN nodes n ON other = n.id
    WHERE sym.id = 'part_3' AND relation = 'calls'""",
)
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.neighbors(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), "part_3", relation="calls")


RELATIONS = ", ".join(f"'{r}'" for r in fixed.AFFECTED_RELATIONS)


@query(
    "affected",
    f"""WITH {STAR_SQL}, walk AS (SELECT id, other, relation FROM sym WHERE relation IN ({RELATIONS})),
    l0 AS (SELECT id, 0 AS depth, 'root' AS via, ord FROM nodes WHERE id = 'region_1'),
    l1 AS (SELECT other AS id, 1 AS depth, arg_min(relation, (l0.ord, relation)) AS via FROM l0 JOIN walk USING (id)
           WHERE other NOT IN (SELECT id FROM l0) GROUP BY other),
    s1 AS (SELECT id, depth, via FROM l0 UNION ALL SELECT * FROM l1),
    l2 AS (SELECT other AS id, 2 AS depth, arg_min(relation, (n.ord, relation)) AS via FROM l1 JOIN nodes n USING (id) JOIN walk USING (id)
           WHERE other NOT IN (SELECT id FROM s1) GROUP BY other),
    s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM l2),
    l3 AS (SELECT other AS id, 3 AS depth, arg_min(relation, (n.ord, relation)) AS via FROM l2 JOIN nodes n USING (id) JOIN walk USING (id)
           WHERE other NOT IN (SELECT id FROM s2) GROUP BY other),
    s3 AS (SELECT * FROM s2 UNION ALL SELECT * FROM l3),
    l4 AS (SELECT other AS id, 4 AS depth, arg_min(relation, (n.ord, relation)) AS via FROM l3 JOIN nodes n USING (id) JOIN walk USING (id)
           WHERE other NOT IN (SELECT id FROM s3) GROUP BY other),
    s4 AS (SELECT * FROM s3 UNION ALL SELECT * FROM l4)
    SELECT s4.id AS node, label, depth, via, source_file FROM s4 JOIN nodes n ON s4.id = n.id WHERE depth > 0""",
)
def affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.affected(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), "region_1").drop("ord")


PATH_SQL = f"""WITH RECURSIVE {STAR_SQL}, hop1 AS (SELECT id, other FROM sym),
walk(id, trail) AS (
  SELECT 'region_2', ['region_2']
  UNION ALL SELECT other, list_append(trail, other) FROM walk JOIN hop1 USING (id)
  WHERE len(trail) <= 4 AND NOT list_contains(trail, other)),
best AS (SELECT trail FROM walk WHERE id = 'part_11' ORDER BY len(trail), trail LIMIT 1),
pairs AS (SELECT CAST(i - 1 AS INTEGER) AS hop, trail[i] AS source, trail[i + 1] AS target FROM best, range(1, 10) t(i) WHERE i < len(trail))
SELECT hop, pairs.source, pairs.target, a.label AS source_label, b.label AS target_label, e.relation, e.confidence
FROM pairs JOIN nodes a ON pairs.source = a.id JOIN nodes b ON pairs.target = b.id
JOIN edges e ON (e.source = pairs.source AND e.target = pairs.target) OR (e.source = pairs.target AND e.target = pairs.source)"""


@query("shortest_path", PATH_SQL)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.path(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), "region_2", "part_11")


# --- communities -----------------------------------------------------------------


@query(
    "communities_given",
    f"""WITH {STAR_SQL}, m AS (SELECT membership.id, cid, label, coalesce(degree, 0) AS degree
       FROM membership JOIN nodes USING (id) LEFT JOIN deg USING (id)),
    named AS (SELECT cid, arg_min(id, (-degree, id)) AS hub, regexp_replace(trim(arg_min(label, (-degree, id))), '\\(\\)$', '') AS label,
              count(*) AS size FROM m GROUP BY cid),
    coh AS (SELECT a.cid, round_even(avg(CASE WHEN a.cid = b.cid THEN 1.0 ELSE 0.0 END), 3) AS cohesion
            FROM sym JOIN membership a ON sym.id = a.id LEFT JOIN membership b ON sym.other = b.id GROUP BY a.cid)
    SELECT cid, hub, label, size, coalesce(cohesion, 0.0) AS cohesion FROM named LEFT JOIN coh USING (cid)""",
)
def communities_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.communities(star_nodes(spark, sf_dir), star_edges(spark, sf_dir), star_membership(spark, sf_dir))


@query(
    "community_numbers",
    f"""WITH {STAR_SQL}, sizes AS (SELECT cid AS community, count(*) AS size FROM membership GROUP BY cid),
    ranked AS (SELECT community, row_number() OVER (ORDER BY size DESC, community) - 1 AS cid FROM sizes)
    SELECT id, ranked.cid FROM membership JOIN ranked ON membership.cid = community""",
)
def community_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.number_communities(star_membership(spark, sf_dir).withColumnRenamed("cid", "community"))


@query(
    "hub_threshold",
    f"""WITH {STAR_SQL}, d AS (SELECT coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0)) - 1 AS pos,
       count(*) OVER () AS n_nodes FROM nodes LEFT JOIN deg USING (id))
    SELECT n_nodes, CAST(degree AS BIGINT) AS threshold FROM d
    WHERE pos = greatest(0, CAST(floor(n_nodes * 99 / 100.0) AS BIGINT) - 1)""",
)
def hub_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = community.node_degrees(star_nodes(spark, sf_dir), star_edges(spark, sf_dir))
    return community.hub_threshold(degree, 99)


@query(
    "majority_vote",
    f"""WITH {STAR_SQL}, votes AS (SELECT sym.id, cid, count(*) AS votes FROM sym JOIN membership ON other = membership.id
       WHERE sym.id LIKE 'part%' GROUP BY sym.id, cid)
    SELECT id, arg_min(cid, (-votes, cid)) AS community, max(votes) AS votes FROM votes GROUP BY id""",
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    hubs = star_nodes(spark, sf_dir).where(F.col("id").startswith("part")).select("id")
    given = star_membership(spark, sf_dir).withColumnRenamed("cid", "community")
    return community.majority_vote(hubs, star_edges(spark, sf_dir), given)


@query(
    "modularity_moves",
    f"""WITH {TRADE_SQL}, adj AS (SELECT source AS u, target AS v, weight AS w FROM trade UNION ALL SELECT target, source, weight FROM trade),
    k AS (SELECT u, sum(w) AS k FROM adj GROUP BY u), m AS (SELECT sum(w) AS total FROM adj),
    opt AS (SELECT adj.u, v AS c, w, ku.k AS k, kv.k AS tot FROM adj JOIN k ku ON adj.u = ku.u JOIN k kv ON adj.v = kv.u
            UNION ALL SELECT u, u, 0, k, k FROM k),
    gains AS (SELECT u, c, round(w - k * (tot - CASE WHEN c = u THEN k ELSE 0 END) / total, 12) AS gain FROM opt, m)
    SELECT u, arg_min(c, (-gain, c)) AS best, max(gain) > max(CASE WHEN c = u THEN gain END) + 1e-12 AS better FROM gains GROUP BY u""",
)
def modularity_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjacency = cut(leiden.weighted_adjacency(trade_edges(spark, sf_dir)))
    state = adjacency.groupBy("u").agg(F.sum("w").alias("k")).select("u", F.col("u").alias("c"), "k")
    total = adjacency.agg(F.sum("w")).first()[0]
    return leiden.best_moves(leiden.candidate_gains(adjacency, state, total, 1.0)).select("u", "best", "better")


@query(
    "cluster_geography",
    f"""WITH {STAR_SQL} SELECT count(*) AS nodes, count(*) AS distinct_nodes, 0 AS movable, 0 AS torn, TRUE AS better_than_given
    FROM nodes WHERE id IN (SELECT id FROM deg)""",
)
def cluster_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of communities of the whole graph: nobody is lost, none is torn, no node gains by moving alone."""
    nodes, edges = star_nodes(spark, sf_dir), cut(star_edges(spark, sf_dir).select("source", "target", "weight"))
    found = community.partition(edges)
    given = nodes.join(star_membership(spark, sf_dir), "id", "left").select("id", F.coalesce(F.col("cid").cast("string"), "id").alias("community"))
    better = community.quality(edges, found).withColumn("given", F.lit(community.modularity(edges, given)))
    counted = found.agg(F.count("*").alias("placed"), F.count_distinct("id").alias("distinct_nodes"))
    return better.crossJoin(counted).select(
        F.col("placed").alias("nodes"), "distinct_nodes", F.col("movable").cast("int").alias("movable"), F.col("torn").cast("int").alias("torn"),
        (F.col("modularity") > F.col("given")).alias("better_than_given"),
    )


HUB_ROUNDS = 6

HUBS_SQL = f"""WITH {STAR_SQL},
all_deg AS (SELECT nodes.id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (id)),
ranked AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS pos, count(*) OVER () AS n FROM all_deg),
hubs AS (SELECT id FROM all_deg WHERE degree > (SELECT degree FROM ranked WHERE pos = greatest(0, CAST(floor(n * 99 / 100.0) AS BIGINT) - 1))),
pairs AS (SELECT DISTINCT id, other FROM sym WHERE id <> other),
p0 AS (SELECT id, CAST(cid AS VARCHAR) AS community FROM membership WHERE id NOT IN (SELECT id FROM hubs))""" + "".join(
    f""",
f{k} AS (SELECT id FROM hubs WHERE id NOT IN (SELECT id FROM p{k - 1}) AND id NOT IN (
  SELECT pairs.id FROM pairs JOIN hubs h ON pairs.other = h.id WHERE other < pairs.id AND other NOT IN (SELECT id FROM p{k - 1}))),
v{k} AS (SELECT sym.id, community, count(*) AS votes FROM sym JOIN f{k} USING (id) JOIN p{k - 1} p ON sym.other = p.id GROUP BY sym.id, community),
p{k} AS (SELECT * FROM p{k - 1} UNION ALL SELECT f{k}.id, coalesce(c, f{k}.id) FROM f{k}
  LEFT JOIN (SELECT id, arg_min(community, (-votes, community)) AS c FROM v{k} GROUP BY id) USING (id))"""
    for k in range(1, HUB_ROUNDS + 1)
)


@query("hubs_reattached", HUBS_SQL + f" SELECT id, community FROM p{HUB_ROUNDS} WHERE id IN (SELECT id FROM hubs)")
def hubs_reattached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-connected percent of nodes voted back into the given communities, in id order."""
    nodes, edges = star_nodes(spark, sf_dir), star_edges(spark, sf_dir)
    edges = cut(edges.select("source", "target"))
    hubs = cut(community.hubs_above(cut(community.node_degrees(nodes, edges)), 99.0).select("id"))
    given = star_membership(spark, sf_dir).select("id", F.col("cid").cast("string").alias("community"))
    placed = community.reattach_hubs(hubs, edges, given.join(hubs, "id", "left_anti"))
    return placed.join(hubs, "id", "left_semi")


@query(
    "cluster_without_hubs",
    f"""WITH {STAR_SQL} SELECT count(*) AS nodes, count(*) AS distinct_nodes, TRUE AS numbered, TRUE AS largest_first FROM nodes""",
)
def cluster_without_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the whole graph, its best-connected percent of nodes reattached by vote, and their numbers."""
    edges = cut(star_edges(spark, sf_dir).select("source", "target", "weight"))
    found = community.cluster(star_nodes(spark, sf_dir), edges, hub_percentile=99.0)
    sizes = found.groupBy("cid").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    later = sizes.select((F.col("cid") - 1).alias("cid"), F.col("n").alias("next"))
    return sizes.join(later, "cid", "left").agg(
        F.sum("n").alias("nodes"),
        F.sum("ids").alias("distinct_nodes"),
        ((F.min("cid") == 0) & (F.max("cid") == F.count("*") - 1)).alias("numbered"),
        F.bool_and(F.col("n") >= F.coalesce("next", F.lit(0))).alias("largest_first"),
    )
