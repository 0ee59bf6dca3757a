"""Usage over time, on batches and on streams alike: the functions take either kind of DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, key: str, width: str, step: str | None = None, late: str | None = None) -> DataFrame:
    """w_start, w_end, key and n by tumbling or sliding windows; `late` is the watermark of a stream."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, width, step) if step else F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """key, s_start, s_end (gap included) and n of runs of events that are less than the gap apart."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("s_start"), F.col("session_window.end").alias("s_end"), "n")


def first_seen(feed: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """A change feed without repeats of a key within the watermark."""
    return feed.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
