"""Reading inputs, and intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.session import ensure_checkpoint_dir

#: Spark removes the shuffle files of a query when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path for a new folder below the shared checkpoint folder, as a URI."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders made by ``new_folder``."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


class Scratch:
    """Written tables of one operator call.

    A table is written once and read as a plain scan, so later jobs do not
    repeat the work before it and survive lost executors. With ``tidy`` the shuffle files behind it
    go when it is written, not when the driver next collects its garbage. ``drop`` removes a
    table that no later plan reads; what the result still reads stays until the
    owner of the checkpoint folder clears it.
    """

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        self.spark, self.label, self.tidy = spark, label, tidy
        self._paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, f"{self.label}-{name}")
        before = self.spark.conf.get(SHUFFLES_GO, "false")
        self.spark.conf.set(SHUFFLES_GO, "true" if self.tidy else before)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        remove(self.spark, *(self._paths.pop(n) for n in names if n in self._paths))
