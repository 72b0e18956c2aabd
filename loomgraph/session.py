"""Session construction and the few runtime helpers that need the session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Applied when we build the session ourselves; a cluster's own session keeps
# whatever it was launched with.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

# Most rows a counted frame may have to be sent to every executor.
BROADCAST_ROWS = 100_000

# Rows of a task whose aggregate hardly shrinks them.
TASK_ROWS = 500_000


def build_session(master: str = "local[*]", app: str = "loomgraph", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a scratch folder; on a cluster the
    checkpoint has to survive the loss of an executor, so it must be shared.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written table.

    Loops plan every round afresh, so a round should start from a plain scan:
    it survives lost executors, carries real sizes for the next round's joins,
    and drags no history of earlier joins through the planner.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_with(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """``cut`` and aggregates of the written rows, taken while they are written."""
    seen = Observation()
    kept = cut(df.observe(seen, *measures))
    return kept, seen.get


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """Keep ``df`` on the executors while a loop reads it again and again.

    The lineage stays, so a lost executor only costs its share of a rerun.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before per-row Python work, at least one task per core.

    The number of partitions is fixed without looking at the input, so planning runs no job.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal a counted frame out by keys before an aggregate over them that hardly shrinks it.

    The number of tasks grows with the rows, so what a task holds does not. A frame that
    the shuffle partitions of the session hold well is returned untouched.
    """
    tasks = -(-rows // TASK_ROWS)
    return df if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(tasks, *keys)


def hint_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a frame whose row count has been measured and is within the limit.

    Beyond it the frame is returned untouched and Spark shuffles it.
    """
    return F.broadcast(df) if rows <= limit else df
