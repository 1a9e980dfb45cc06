"""Optional broker and Avro adapters.

The Kafka connector and the Avro functions ship as separate Spark packages.
When they are on the classpath these functions build the standard readers
and writers; when they are not, they raise a clear error and the file
archive (``sources.archive``) is the source and sink to use.  The option
maps are plain dicts, so they are testable without a broker.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Default topic name, and the producer settings of the collector's sink (fixed values).
TOPIC = "clickstream"
PRODUCER = {"compression.type": "lz4", "acks": "1", "retries": "0"}


def source_options(brokers: list[str] | str, topic: str = TOPIC, group: str | None = None,
                   starting: str = "latest") -> dict[str, str]:
    """Reader options.  Consumer settings go with the ``kafka.`` prefix;
    the group id is only a hint to the connector (it tracks offsets itself
    in the checkpoint)."""
    opts = {
        "kafka.bootstrap.servers": brokers if isinstance(brokers, str) else ",".join(brokers),
        "subscribe": topic,
        "startingOffsets": starting,
    }
    if group:
        opts["kafka.group.id"] = group
    return opts


def sink_options(brokers: list[str] | str, topic: str = TOPIC) -> dict[str, str]:
    """Writer options, with the collector's producer settings."""
    opts = {"kafka.bootstrap.servers": brokers if isinstance(brokers, str) else ",".join(brokers),
            "topic": topic}
    opts.update({f"kafka.{k}": v for k, v in PRODUCER.items()})
    return opts


def read_stream(spark: SparkSession, brokers, topic: str = TOPIC, group: str | None = None,
                starting: str = "latest") -> DataFrame:
    """The click stream as (key, value, topic, partition, offset, ...)."""
    try:
        return spark.readStream.format("kafka").options(
            **source_options(brokers, topic, group, starting)).load()
    except AnalysisException as ex:
        if "kafka" not in str(ex).lower() or "find" not in str(ex).lower():
            raise  # the connector is there; something else is wrong
        raise RuntimeError("Kafka connector not available; read the event archive instead "
                           "(shoplytics.sources.archive.stream_archive)") from ex


def write_stream(df: DataFrame, brokers, checkpoint: str, topic: str = TOPIC):
    """Publish records as JSON values keyed by event id."""
    out = df.select(F.col("eventId").cast("string").alias("key"),
                    F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
    return (out.writeStream.format("kafka").options(**sink_options(brokers, topic))
               .option("checkpointLocation", checkpoint))


def decode_avro(value: Column, avro_schema_json: str) -> Column:
    """A bare Avro datum (no registry header) to a struct, with the
    built-in decoder (no Python UDF)."""
    try:
        from pyspark.sql.avro.functions import from_avro
    except ImportError as ex:  # pragma: no cover
        raise RuntimeError("Avro functions not available") from ex
    return from_avro(value, avro_schema_json, {"mode": "PERMISSIVE"})
