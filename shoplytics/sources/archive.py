"""Event archive: file sources and sinks.

The collector rolls event files into a directory; here that directory is a
Parquet (or JSON-lines) folder read back as a batch or a stream with a
declared schema (no inference).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

# Fixed value: the collector's file roll interval.
ROLL_INTERVAL = "30 seconds"


def read_archive(spark: SparkSession, path: str, schema: T.StructType,
                 fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    """S2 batch: read the archived event files."""
    r = spark.read.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def stream_archive(spark: SparkSession, path: str, schema: T.StructType,
                   fmt: str = "parquet", glob: str | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """S2 stream: new files in the archive folder become micro-batches."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


# Lossless JSON timestamps (microseconds; the defaults keep milliseconds).
JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def parse_json_records(df: DataFrame, schema: T.StructType | str, col: str = "value",
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse a JSON string column with a declared schema and flatten it
    (next to the ``keep`` columns).  Malformed records become NULL fields
    (PERMISSIVE)."""
    opts = {"mode": "PERMISSIVE", **JSON_OPTIONS}
    return (df.select(*keep, F.from_json(F.col(col).cast("string"), schema, opts).alias("json"))
              .select(*keep, "json.*"))


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per record."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), JSON_OPTIONS)
                     .alias("value"))


def rolling_file_sink(df: DataFrame, path: str, checkpoint: str,
                      fmt: str = "parquet", interval: str | None = ROLL_INTERVAL) -> DataStreamWriter:
    """Roll the stream into files every ``interval`` (``None``: process
    what is available and stop).  The checkpoint's commit log is the atomic
    publish step: readers of ``path`` only see files of committed batches."""
    w = (df.writeStream.format(fmt).outputMode("append")
           .option("path", path).option("checkpointLocation", checkpoint))
    return w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)
