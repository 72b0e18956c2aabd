"""Event-time aggregates over a stream of events (event_id, ts, user_id, event_type, value).

The watermark follows the latest event time by ``delay``: a row that is older than it is
late and left out, a window or session that ends before it is final and emitted once, and
ids are remembered only that long. State so stays bounded by what ``delay`` spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _measures() -> list:
    return [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")]


def once(events: DataFrame, delay: str) -> DataFrame:
    """Events without repeats of an id that arrive within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, width: str, delay: str) -> DataFrame:
    """(start, event_type, n, total) for each closed window of ``width``."""
    grouped = once(events, delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(*_measures())
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """(user_id, start, end, n, total): runs of a user's events with less than ``gap`` between them, once they are over.

    ``end`` is the last event's time plus the gap.
    """
    grouped = once(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(*_measures())
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
