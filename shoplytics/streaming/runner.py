"""Stream run loop and output sinks (ST4, ST5, S8, X2).

A job is a plain ``DataFrame -> DataFrame`` function; the same function runs
on a static DataFrame (batch) and on a streaming one.  ``start`` wires a job
between a source and a sink; ``run_to_table`` drives a stream to completion
with an idempotent per-batch table sink, so the final state can be read back
as a batch DataFrame without passing through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoplytics.session import scratch

Job = Callable[[DataFrame], DataFrame]


def output(df: DataFrame, fmt: str = "console", mode: str = "update"):
    """The job's output writer (update mode by default)."""
    return df.writeStream.outputMode(mode).format(fmt)


def start(source: DataFrame, job: Job, fmt: str = "console", mode: str = "update",
          checkpoint: str | None = None, query_name: str | None = None,
          available_now: bool = False) -> StreamingQuery:
    """ST5: run ``job`` over ``source`` into a sink and return the running query.
    Callers block with ``awaitTermination()``."""
    w = output(source.transform(job), fmt, mode)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def run_to_table(source: DataFrame, job: Job, keys: Sequence[str], out_dir: str,
                 checkpoint: str, mode: str = "update") -> DataFrame:
    """Run ``job`` over everything available, writing each micro-batch's
    updated rows to ``out_dir/batch=<id>`` (overwrite, so a replayed batch is
    idempotent), then return the latest row per key as a batch DataFrame."""
    spark = source.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))

    out = source.transform(job)
    q = (out.writeStream.outputMode(mode)
         .foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if not path_exists(spark, out_dir):
        if any(p.numInputRows for p in q.recentProgress):
            raise RuntimeError(f"the stream read rows, but no batch wrote to {out_dir}")
        # No micro-batch ran (empty source): an empty result, not an error.
        return spark.createDataFrame([], out.schema)
    return latest_per_key(spark.read.parquet(out_dir), keys)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster file system (works for shared
    storage, unlike a local ``os.path`` check)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def latest_per_key(updates: DataFrame, keys: Sequence[str], batch_col: str = "batch") -> DataFrame:
    """Update-mode output holds one row per changed key per batch; keep the
    newest.  ``max_by`` of the row combines on the map side; over string columns
    Spark plans it as a sort aggregate."""
    cols = [c for c in updates.columns if c not in keys and c != batch_col]
    latest = updates.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.col(batch_col)).alias("__row"))
    return latest.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in cols])

