"""Streams that carry a table from micro-batch to micro-batch.

``fold`` runs a step on every micro-batch: (rows, carried table) -> named output tables, one of
them the next carried table, ``STATE``.  All of them are Spark tables in shared storage, one folder
a batch, so a step may join, shuffle and aggregate as a batch job does, and a replayed batch reads
the same carried table and overwrites its own folders.

Steps:

* ``late_step`` - ST3: rows whose window had ended by the watermark go to a table of their own;
* ``duplicate_step`` - F11: copies of an event id and damaged events are flagged, and kept;
* ``session_step`` - M1: sessions that arrive in pieces, in any order within the watermark.

The watermark of a batch is the latest event time of all batches before it, less the delay.  Rows
without an event time have no window, are never late, and move no watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplytics.functions.times import epoch_micros
from shoplytics.operators import sessions, traffic

STATE = "state"
Step = Callable[[DataFrame, DataFrame], dict[str, DataFrame]]


def fold(source: DataFrame, step: Step, state_schema: str, base: str) -> None:
    """Take everything available from ``source`` through ``step``; the tables are under ``base``."""
    spark = source.sparkSession

    def sink(batch: DataFrame, k: int) -> None:
        before = batch.sparkSession.read.parquet(f"{base}/{STATE}/batch={k - 1}") if k else \
            batch.sparkSession.createDataFrame([], state_schema)
        for name, df in step(batch, before).items():
            df.write.mode("overwrite").parquet(f"{base}/{name}/batch={k}")
        if k > 1:  # a replay of this batch or the next reads k - 1 or k
            _delete(batch.sparkSession, f"{base}/{STATE}/batch={k - 2}")

    (source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """All rows that the batches wrote to one output."""
    return spark.read.option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")


def replay(spark: SparkSession, rows: DataFrame, arrival: str, base: str, step: Step, state_schema: str) -> None:
    """A job started once per arrival: each run finds the files that came since the last one.
    ``arrival`` counts runs, so it has few values."""
    schema = rows.drop(arrival).schema
    for (k,) in rows.select(arrival).distinct().orderBy(arrival).collect():
        rows.filter(F.col(arrival) == k).drop(arrival).write.parquet(f"{base}/in/run-{k}")
        fold(spark.readStream.schema(schema).parquet(f"{base}/in/run-*"), step, state_schema, base)


# --- late rows -------------------------------------------------------------

LATE_STATE = "mark_us long"


def _mark(batch: DataFrame, ts: str, before: DataFrame) -> DataFrame:
    """One row: the latest event time so far, in microseconds."""
    return batch.select(epoch_micros(ts).alias("mark_us")).unionByName(before.select("mark_us")) \
                .agg(F.max("mark_us").alias("mark_us"))


def late_step(ts: str = "ts", type_col: str = "event_type", delay_s: int = 120, window_s: int = 60) -> Step:
    """Outputs: ``late``, the late rows as they came; ``counts``, what the batch adds to each
    (window, type), to be summed when read; the carried table is one row, the latest event time."""

    def step(batch: DataFrame, before: DataFrame) -> dict[str, DataFrame]:
        mark = before.agg(F.max("mark_us")).scalar()
        end = (F.floor(epoch_micros(ts) / (window_s * 10**6)) + 1) * (window_s * 10**6)
        rows = batch.withColumn("__late", F.coalesce(end <= mark - delay_s * 10**6, F.lit(False)))
        on_time = rows.filter(~F.col("__late"))
        return {"late": rows.filter("__late").drop("__late"),
                "counts": traffic.count_per_window(on_time, ts, type_col, f"{window_s} seconds"),
                STATE: _mark(batch, ts, before)}

    return step


# --- duplicates and damage -------------------------------------------------

DUPLICATE_STATE = "event_id long, last_us long, mark_us long"


def duplicate_step(ts: str = "ts", key: str = "event_id", horizon_s: int = 6 * 86400,
                   body: str = "props", checksum: str = "checksum") -> Step:
    """Output ``flagged``: every row, with ``detected_duplicate`` (a copy of its id came in an
    earlier batch and is still remembered, or stands before it in this batch by event time) and
    ``detected_corruption`` (the checksum sent is not that of the body).  An id is remembered until its latest copy is
    ``horizon_s`` older than the latest event; a row without an id is no copy."""

    def step(batch: DataFrame, before: DataFrame) -> dict[str, DataFrame]:
        seen = before.filter(F.col(key).isNotNull()).select(key, F.lit(True).alias("__seen"))
        content = batch.withColumn("__content", F.xxhash64(*batch.columns))  # equal times: by content
        rows = sessions.flag_duplicates(content, key, (ts, "__content")).join(seen, key, "left")
        copy = F.col("detected_duplicate") | F.coalesce(F.col("__seen"), F.lit(False))
        damaged = F.crc32(F.col(body).cast("binary")) != F.col(checksum)
        flagged = rows.withColumn("detected_duplicate", F.col(key).isNotNull() & copy) \
                      .withColumn("detected_corruption", F.coalesce(damaged, F.lit(False))).drop("__seen", "__content")
        mark = _mark(batch, ts, before)
        last = (batch.select(key, epoch_micros(ts).alias("last_us")).unionByName(before.select(key, "last_us"))
                .filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("last_us").alias("last_us")))
        # One row without an id carries the mark, should every id be forgotten.
        kept = last.withColumn("mark_us", mark.scalar()).filter(F.col("last_us") >= F.col("mark_us") - horizon_s * 10**6)
        alone = mark.select(F.lit(None).cast("long").alias(key), F.lit(None).cast("long").alias("last_us"), "mark_us")
        return {"flagged": flagged, STATE: kept.select(key, "last_us", "mark_us").unionByName(alone)}

    return step


# --- sessions --------------------------------------------------------------

SESSION_STATE = "party long, first_us long, last_us long, n_events long, mark_us long"


def session_step(ts: str = "ts", party: str = "party", delay_s: int = 12 * 86400,
                 timeout_s: int = sessions.SESSION_TIMEOUT_SECONDS) -> Step:
    """Output ``closed``: sessions that no event in time can reach any more.  The carried table
    holds the open ones.  A batch is first reduced to pieces, the events of a party in
    one stretch of the timeout's length, which belong to one session whatever comes: a party with a third
    of all events is a row per stretch after the map-side aggregation.  Late events open a session of their own."""
    us = timeout_s * 10**6

    def step(batch: DataFrame, before: DataFrame) -> dict[str, DataFrame]:
        at = epoch_micros(ts)
        pieces = (batch.filter(F.col(ts).isNotNull()).withColumn("__us", at)
                  .groupBy(F.col(party).alias("party"), F.floor(F.col("__us") / us).alias("__stretch"))
                  .agg(F.min("__us").alias("first_us"), F.max("__us").alias("last_us"), F.count(F.lit(1)).alias("n_events")))
        open_ = before.filter(F.col("first_us").isNotNull()).select("party", "first_us", "last_us", "n_events")
        order = Window.partitionBy("party").orderBy("first_us", "last_us")
        reach = F.max("last_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
        new = (reach.isNull() | (F.col("first_us") - reach > us)).cast("long")
        merged = (pieces.drop("__stretch").unionByName(open_).withColumn("__new", new)
                  .withColumn("__no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                  .groupBy("party", "__no").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
                                                F.sum("n_events").alias("n_events")).drop("__no"))
        mark = _mark(batch, ts, before)
        all_ = merged.withColumn("mark_us", mark.scalar())
        done = F.col("last_us") + us < F.coalesce(F.col("mark_us") - delay_s * 10**6, F.col("last_us"))
        alone = mark.select(*[F.lit(None).cast("long").alias(c) for c in ("party", "first_us", "last_us", "n_events")], "mark_us")
        return {"closed": all_.filter(done).drop("mark_us"), STATE: all_.filter(~done).unionByName(alone)}

    return step


def all_sessions(spark: SparkSession, base: str, timeout_s: int = sessions.SESSION_TIMEOUT_SECONDS) -> DataFrame:
    """party, session_start, session_end, n_events: the closed sessions, and those still open."""
    states = spark.read.parquet(f"{base}/{STATE}")
    newest = states.filter(F.col("batch") == states.agg(F.max("batch")).first()[0]).filter("first_us IS NOT NULL")
    cols = ["party", "first_us", "last_us", "n_events"]
    return read(spark, base, "closed").select(*cols).unionByName(newest.select(*cols)).select(
        "party", F.timestamp_micros("first_us").alias("session_start"),
        F.timestamp_micros(F.col("last_us") + timeout_s * 10**6).alias("session_end"), "n_events")
