"""Fragments of earlier builds: written once, known by path and content, read by version.

::

    <store>/delta/<records>/delta=N   what run N extracted
    <store>/files/v=N                 the files of version N: stat, hash, kind, and the delta of each

A run writes only what it extracted; files that are as they were point at the delta that
has their fragment, also when an older content comes back. The file list is written last,
and a version without it does not exist. Older versions stay readable until ``expire``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import cut, cut_with

RECORDS = ("nodes", "edges", "calls", "definitions")

FILES = "path string, size long, mtime_ns long, hash string, file_type string, words long, delta long, failed boolean"

#: A version whose fragments lie in more deltas than this is written together.
MOST_DELTAS = 32

#: Most 64-bit hashes of paths that go to every task.
MOST_HASHES = 1_000_000


def _folders(spark: SparkSession, parent: str, prefix: str, mark: str = "_SUCCESS") -> list[int]:
    """Numbers of the folders ``<prefix>N`` below ``parent`` whose write was finished."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(parent)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [s.getPath() for s in system.listStatus(folder) if s.getPath().getName().startswith(prefix)]
    return sorted(int(p.getName().removeprefix(prefix)) for p in found if system.exists(path(p, mark)))


def _delete(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def versions(spark: SparkSession, store: str) -> list[int]:
    """Complete versions, oldest first."""
    return _folders(spark, f"{store}/files", "v=")


def file_list(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.schema(FILES).parquet(f"{store}/files/v={version}")


def latest_files(spark: SparkSession, store: str) -> DataFrame | None:
    """Files of the newest version, or None in a new store."""
    done = versions(spark, store)
    return file_list(spark, store, done[-1]) if done else None


def _owned(records: DataFrame) -> DataFrame:
    """Add ``owner``, the path of the file whose fragment a record belongs to."""
    return records.withColumn("owner", F.regexp_replace("fragment_key", "^manifest:", "") if "fragment_key" in records.columns else F.col("path"))


def refresh(
    spark: SparkSession, files: DataFrame, store: str, extract: Callable[[DataFrame], dict[str, DataFrame]], reuse: bool = True
) -> tuple[int, int, int]:
    """Add a version for ``files`` and return (version, reused files, extracted files).

    ``files`` (path, size, mtime_ns, hash, file_type, words, content) needs the content of
    files that no earlier version has with the same hash. ``extract`` takes (path, content)
    and returns the records and ``errors``; files with an error are extracted again next time.
    """
    done = versions(spark, store)
    version = done[-1] + 1 if done else 0
    listed = files.select("path", "size", "mtime_ns", "hash", "file_type", "words")
    if reuse and done:
        known = spark.read.schema(FILES).parquet(*[f"{store}/files/v={v}" for v in done]).where("not failed")
        placed = listed.join(known.groupBy("path", "hash").agg(F.max("delta").alias("delta")), ["path", "hash"], "left")
    else:
        placed = listed.withColumn("delta", F.lit(None).cast("long"))
    placed, seen = cut_with(placed, F.count(F.lit(1)).alias("total"), F.count("delta").alias("reused"))
    total, reused = seen["total"], seen["reused"]
    failed = None
    if reused < total or not total:
        fresh = files.select("path", "content")
        if reused:
            fresh = _of_paths(fresh, placed.where("delta is null").select("path"), total - reused)
        records = extract(fresh)
        for name in (*RECORDS, "errors"):
            _owned(records[name]).write.mode("overwrite").parquet(f"{store}/delta/{name}/delta={version}")
        failed = spark.read.parquet(f"{store}/delta/errors/delta={version}").select(F.col("owner").alias("path"), F.lit(True).alias("failed")).distinct()
    # Errors are those of this run: a file that is reused had none.
    marked = placed.withColumn("failed", F.lit(False)) if failed is None else placed.join(failed, "path", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    _list_files(marked.withColumn("delta", F.coalesce("delta", F.lit(version).cast("long"))), store, version)
    if len(_deltas(file_list(spark, store, version))) > MOST_DELTAS:
        version = compact(spark, store)
    return version, reused, total - reused


def _of_paths(files: DataFrame, paths: DataFrame, n: int) -> DataFrame:
    """The files of ``n`` paths, written once: extraction reads its input several times.

    Contents of other files are not shuffled: hashes of up to ``MOST_HASHES`` paths go to
    every task, and the exact join meets what they leave.
    """
    if n <= MOST_HASHES:
        hashes = paths.select(F.xxhash64("path").alias("h")).distinct()
        files = files.withColumn("h", F.xxhash64("path")).join(F.broadcast(hashes), "h", "left_semi").drop("h")
    return cut(files.join(paths, "path", "left_semi"))


def _list_files(files: DataFrame, store: str, version: int) -> None:
    files.select("path", "size", "mtime_ns", "hash", "file_type", "words", "delta", "failed").write.mode("overwrite").parquet(f"{store}/files/v={version}")


def _deltas(files: DataFrame) -> list[int]:
    """Deltas that a version reads: as many as runs since it was compacted, at most."""
    return sorted(r[0] for r in files.select("delta").distinct().collect())


def _live(spark: SparkSession, store: str, version: int, name: str, deltas: list[int]) -> DataFrame:
    folder = f"{store}/delta/{name}"
    rows = spark.read.option("basePath", folder).parquet(*[f"{folder}/delta={d}" for d in deltas or [version]])
    own = file_list(spark, store, version).select(F.col("path").alias("owner"), "delta")
    return rows.withColumn("delta", F.col("delta").cast("long")).join(own, ["owner", "delta"], "left_semi").drop("delta")


def read(spark: SparkSession, store: str, version: int) -> dict[str, DataFrame]:
    """The records of a version."""
    deltas = _deltas(file_list(spark, store, version))
    return {name: _live(spark, store, version, name, deltas).drop("owner") for name in RECORDS}


def compact(spark: SparkSession, store: str) -> int:
    """Write the newest version's fragments into one delta, as a version of its own, and return its number."""
    last = versions(spark, store)[-1]
    files = file_list(spark, store, last)
    deltas = _deltas(files)
    for name in (*RECORDS, "errors"):
        _live(spark, store, last, name, deltas).write.mode("overwrite").parquet(f"{store}/delta/{name}/delta={last + 1}")
    _list_files(files.withColumn("delta", F.lit(last + 1).cast("long")), store, last + 1)
    return last + 1


def expire(spark: SparkSession, store: str, keep: int = 1) -> None:
    """Delete all but the newest ``keep`` versions, and the deltas that none of these reads."""
    done = versions(spark, store)
    gone, stay = done[:-keep], done[-keep:]
    for version in gone:
        _delete(spark, f"{store}/files/v={version}")
    used = {d for v in stay for d in (_deltas(file_list(spark, store, v)) or [v])}
    for name in (*RECORDS, "errors"):
        for delta in _folders(spark, f"{store}/delta/{name}", "delta="):
            if delta not in used:
                _delete(spark, f"{store}/delta/{name}/delta={delta}")
