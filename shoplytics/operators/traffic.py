"""Traffic counts over the click stream.

The same DataFrame -> DataFrame functions drive the batch jobs and the
streaming jobs (``shoplytics.streaming.traffic``): a job is a plain function
composed with ``df.transform``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Window length and watermark delay of the per-minute count.
WINDOW = "1 minute"
WATERMARK = "2 minutes"


def all_events(df: DataFrame) -> DataFrame:
    """The identity job."""
    return df


def with_event_time(df: DataFrame, ms_col: str = "timestamp",
                    type_col: str = "eventType") -> DataFrame:
    """Keep the event type and turn epoch milliseconds into a timestamp."""
    return df.select(F.col(type_col).alias("eventType"),
                     F.timestamp_millis(F.col(ms_col)).alias("ts"))


def count_per_window(df: DataFrame, ts_col: str = "ts", type_col: str = "eventType",
                     window: str = WINDOW) -> DataFrame:
    """A1: events per (tumbling window, event type).

    A hash aggregate with map-side partial counts: the shuffle carries one
    row per (window, type) per input partition, not one per event.
    """
    return (df.groupBy(F.window(F.col(ts_col), window).alias("w"), F.col(type_col))
              .agg(F.count(F.lit(1)).alias("count"))
              .select(F.col("w.start").alias("window_start"),
                      F.col("w.end").alias("window_end"),
                      F.col(type_col), "count"))


def events_per_minute(df: DataFrame) -> DataFrame:
    """The reference streaming job's query on (eventType, timestamp ms) input,
    with its 2-minute watermark (no effect in batch)."""
    return (with_event_time(df)
            .withWatermark("ts", WATERMARK)
            .transform(count_per_window))
