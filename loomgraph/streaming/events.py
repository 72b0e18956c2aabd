"""The event log: an ordered, append-only stream that can be replayed and tailed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# The event vocabulary.
EVENT_TYPES = "run_started plan tool_call tool_result react_action react_observation synthesis done metrics".split()
TERMINAL = "done"

EVENT_SCHEMA = "seq long, ts string, type string, payload string"


def event(kind: str, seq: Column, ts: Column, **fields: Column) -> Column:
    """One event as a struct; its fields are a JSON payload."""
    kept = [value.alias(name) for name, value in fields.items()]
    return F.struct(seq.alias("seq"), ts.alias("ts"), F.lit(kind).alias("type"), F.to_json(F.struct(*kept)).alias("payload"))


def append_events(events: DataFrame, log: str) -> None:
    """Add events to the log; what is there is never rewritten."""
    events.select("seq", "ts", "type", "payload").write.mode("append").json(log)


def replay(spark: SparkSession, log: str) -> DataFrame:
    """The log so far, in order."""
    return spark.read.schema(EVENT_SCHEMA).json(log).orderBy("seq")


def tail(spark: SparkSession, log: str, after_seq: int = 0) -> DataFrame:
    """A stream that first replays the log and then follows it."""
    return spark.readStream.schema(EVENT_SCHEMA).json(log).where(F.col("seq") > after_seq)


def deliver(events: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Drain what is available into ``sink`` exactly once; a restart continues from the checkpoint."""
    return (
        events.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )


def collect_in_memory(events: DataFrame, name: str) -> StreamingQuery:
    """In-memory collector for tests and short runs."""
    return events.writeStream.format("memory").queryName(name).trigger(availableNow=True).outputMode("append").start()


def finished(log: DataFrame) -> DataFrame:
    """One row: how many events there are, and whether the run has ended."""
    return log.agg(F.count("*").alias("events"), F.coalesce(F.max(F.col("type") == TERMINAL), F.lit(False)).alias("ended"))
