"""Centroid clustering of integer vectors with JVM expressions.

Components become integers, so sums and distances are exact and every rerun and every
partitioning gives the same clusters. The centroids are literal arrays in the plan:
``zip_with`` and ``aggregate`` compute each squared distance, ``array_min`` of structs
(distance, number) chooses the cluster, and a round is one aggregation that sums every
component as a column of its own. Between rounds only the sums, a row for each cluster,
reach the driver. The vectors are written once and each round scans that table, so a lost
executor costs its tasks and nothing before them.

Edge cases: vectors that are null, of another length, or hold a null, NaN or infinite
component are left out; components stay within plus or minus 2^27, those beyond count as
that bound; a null id is hashed as an empty one; repeated ids and rows are vectors of their
own; equal hashes are ordered by components; with fewer vectors than clusters there are as
many clusters as vectors; an empty table gives no rows; other columns are ignored. A sum of
distances beyond a long is null.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tables import Scratch

SCALE, LIMIT = 1024, 1 << 27

Centroids = list[list[int]]


def integers(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, v): the usable vectors, their components as bounded integers."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("v")).where((F.size("v") == size) & finite)
    within = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x * SCALE))
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(within(x))).alias("v"))


def nearest(centroids: Centroids, v: str = "v") -> Column:
    """struct(distance, cluster) of the nearest centroid; the smaller number of equally near ones."""
    # As text: thousands of literals are parsed faster than they are sent to the JVM one by one.
    arrays = ["array(" + ",".join(f"{c}L" for c in centroid) + ")" for centroid in centroids]
    far = [f"aggregate(zip_with({v}, {c}, (x, c) -> (x - c) * (x - c)), 0L, (total, d) -> total + d)" for c in arrays]
    return F.expr("array_min(array(" + ", ".join(f"named_struct('distance', {d}, 'cluster', {k})" for k, d in enumerate(far)) + "))")


def start(vectors: DataFrame, clusters: int, seed: str) -> Centroids:
    """The vectors whose ids hash lowest."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select(name.alias("name"), "v").orderBy("name", "v").limit(clusters).collect()]


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """The floored mean of each centroid's vectors; a centroid without vectors stays."""
    size = len(centroids[0])
    placed = vectors.select(nearest(centroids)["cluster"].alias("cluster"), *[F.expr(f"v[{i}]").alias(f"v{i}") for i in range(size)])
    sums = placed.groupBy("cluster").agg(F.count("*").alias("n"), *[F.expr(f"sum(v{i})").alias(f"v{i}") for i in range(size)])
    out = list(centroids)
    for row in sums.collect():  # a row for each cluster
        out[row["cluster"]] = [row[f"v{i}"] // row["n"] for i in range(size)]
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = 8, rounds: int = 10, size: int = 64, seed: str = "3") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector."""
    scratch = Scratch(vectors.sparkSession, "centroids")
    held = scratch.put("vectors", integers(vectors, size))
    centroids = start(held, clusters, seed)
    if not centroids:
        columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], columns)
    for _ in range(rounds):
        centroids = moved(held, centroids)
    placed = scratch.put("placed", held.select("vec_id", nearest(centroids).alias("at")).select("vec_id", "at.cluster", "at.distance"))
    scratch.drop("vectors")
    found = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()  # a row for each cluster
    sums = {r["cluster"]: int(r["inertia"]) for r in found}
    longs = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    return placed.select(
        "vec_id", "cluster", "distance",
        F.array(*[longs(sums.get(k, 0)) for k in range(len(centroids))])[F.col("cluster")].alias("cluster_inertia"),
        longs(sum(sums.values())).alias("inertia"),
        F.array(*[F.lit(digest(c)) for c in centroids])[F.col("cluster")].alias("centroid_sha256"),
    )
