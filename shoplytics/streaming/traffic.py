"""Per-minute traffic counts as a Structured Streaming job (ST1-ST5).

Event time is watermarked 2 minutes behind the latest event seen; a row whose
window ends before the watermark of the previous micro-batch is dropped as
late.  Output is update mode: every batch emits the windows it changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytics.functions.times import to_instant

from shoplytics.operators import traffic
from shoplytics.sources import archive, bindings
from shoplytics.sources.tables import table, table_path
from shoplytics.streaming import runner


# Bounds what one micro-batch of a stream over stored files holds.
FILES_PER_BATCH = 64


def per_minute(df: DataFrame, ts_col: str = "ts", type_col: str = "eventType") -> DataFrame:
    """ST1 + ST2 + A1: watermark, tumbling 1-minute window, count per type.
    Streaming watermarks need TIMESTAMP (not TIMESTAMP_NTZ): cast under UTC."""
    ts = F.col(ts_col)
    return (df.withColumn(ts_col, ts if dict(df.dtypes)[ts_col] == "timestamp" else to_instant(ts))
              .withWatermark(ts_col, traffic.WATERMARK)
              .transform(lambda d: traffic.count_per_window(d, ts_col, type_col)))


def event_table_stream(spark: SparkSession, sf_dir: str,
                       max_files_per_trigger: int = FILES_PER_BATCH) -> DataFrame:
    """The events table read as a file stream (new files = new batches).
    The table may be one file or a folder of files."""
    bindings.use_utc(spark)
    # A pattern that matches this one name: a stream takes a folder or a pattern, no file.
    path = table_path(sf_dir, "events")[:-1] + "[t]"
    schema = table(spark, sf_dir, "events").schema
    return archive.stream_archive(spark, path, schema, max_files_per_trigger=max_files_per_trigger)


def events_per_minute_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the per-minute job over the event stream to completion and return
    the final count per (window, type)."""
    src = event_table_stream(spark, sf_dir).select("ts", "event_type")
    out = runner.scratch(spark, "events-per-minute")
    res = runner.run_to_table(src, lambda d: per_minute(d, "ts", "event_type"),
                              ["window_start", "event_type"], out + "/data", out + "/ckpt")
    return res.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      "event_type", "count")
