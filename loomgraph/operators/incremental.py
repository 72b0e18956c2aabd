"""Incremental rebuild: what changed since the last snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("hash", F.sha2(F.col(content), 256))


def with_known_hash(files: DataFrame, stat_index: DataFrame) -> DataFrame:
    """Reuse the indexed hash where size and mtime are unchanged, else null."""
    known = stat_index.select("path", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.col("hash").alias("old_hash"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime"))
    return files.join(known, "path", "left").withColumn("hash", F.when(same, F.col("old_hash"))).drop("old_size", "old_mtime", "old_hash")


def current_hashes(files: DataFrame, stat_index: DataFrame, contents: DataFrame) -> DataFrame:
    """(path, size, mtime_ns, hash): only files whose stat changed are read.

    ``contents`` (path, content) joins the changed paths alone, so unchanged
    content is filtered out before hashing.
    """
    stated = with_known_hash(files, stat_index)
    changed = stated.where(F.col("hash").isNull()).drop("hash")
    fresh = changed.join(contents.select("path", "content"), "path").withColumn("hash", F.sha2("content", 256)).drop("content")
    return stated.where(F.col("hash").isNotNull()).unionByName(fresh)


def split_cached(current: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replayable, to_extract): a fragment is reusable when its path and hash are unchanged."""
    keys = ["path", "hash"]
    known = snapshot.select(*keys).distinct()
    return current.join(known, keys, "left_semi"), current.join(known, keys, "left_anti")


def change_summary(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(status, n): unchanged / changed / added / removed paths."""
    old = snapshot.select("path", F.col("hash").alias("old_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("hash").isNull(), "removed")
        .when(F.col("hash") == F.col("old_hash"), "unchanged")
        .otherwise("changed")
    )
    joined = current.select("path", "hash").join(old, "path", "full")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
