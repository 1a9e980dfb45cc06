"""The stored catalog (S13): documents by id, written over whole, last write wins.

Rows lie in Parquet folders by a hash of the id.  A merge rewrites only the folders that an update's id
falls in, under its own version, and then writes a manifest: for each folder, the version that holds it.  Readers
follow the newest manifest, so they see a merge whole or not at all, and files that a merge doesn't
touch keep their names.  A merge that failed or is run again reads the versions before its own and writes
the same rows, so the last merge can be replayed.

The manifest has one row a folder; it and the touched folders' numbers are what the driver holds.
Choose the number of folders so that one is a task's work: it is fixed when the store is created.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytics.operators import catalog

FOLDERS = 64


def _folder(n: int):
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _versions(spark: SparkSession, base: str, before: int | None = None) -> dict[int, int]:
    """Folder -> version, by the newest manifest (of those before one version)."""
    all_ = spark.read.schema("folder int, held int, version int").parquet(f"{base}/manifest")
    if before is not None:
        all_ = all_.filter(F.col("version") < before)
    newest = all_.agg(F.max("version")).first()[0]
    return {r.folder: r.held for r in all_.filter(F.col("version") == newest).collect()}


def _publish(spark: SparkSession, base: str, version: int, held: dict[int, int]) -> None:
    rows = spark.createDataFrame(sorted(held.items()), "folder int, held int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/version={version}")


def _write(rows: DataFrame, base: str, version: int) -> None:
    rows.repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{base}/data/version={version}")


def create(items: DataFrame, base: str, folders: int = FOLDERS, order_col: str = "ord") -> None:
    """Version 0: one document per id; of several, the newest by ``order_col``."""
    spark = items.sparkSession
    _write(catalog.upsert(items.limit(0), items, order_col).withColumn("folder", _folder(folders)), base, 0)
    got = [] if items.isEmpty() else spark.read.parquet(f"{base}/data/version=0").select("folder").distinct().collect()
    # Folders without a document are held by no version.
    _publish(spark, base, 0, {i: -1 for i in range(folders)} | {r.folder: 0 for r in got})


def _read(spark: SparkSession, base: str, held: dict[int, int], like: DataFrame | None = None) -> DataFrame:
    paths = [f"{base}/data/version={v}/folder={f}" for f, v in sorted(held.items()) if v >= 0]
    reader = spark.read if like is None else spark.read.schema(like.schema)
    if paths:
        return reader.parquet(*paths)
    return spark.createDataFrame([], like.schema)


def read(spark: SparkSession, base: str, schema=None) -> DataFrame:
    """The newest state.  ``schema`` is needed only where the store may be empty."""
    return _read(spark, base, _versions(spark, base), None if schema is None else spark.createDataFrame([], schema))


def merge(updates: DataFrame, base: str, version: int, order_col: str = "ord") -> None:
    """Write ``updates`` over the stored documents of their ids, as version ``version`` (1, 2, ...): an
    older update than the stored document loses."""
    spark = updates.sparkSession
    held = _versions(spark, base, version)
    placed = updates.withColumn("folder", _folder(len(held)))
    touched = {r.folder: held[r.folder] for r in placed.select("folder").distinct().collect()}
    if touched:
        stored = _read(spark, base, touched, updates)
        merged = catalog.upsert(stored, updates.select(*stored.columns), order_col)
        _write(merged.withColumn("folder", _folder(len(held))), base, version)
    _publish(spark, base, version, held | dict.fromkeys(touched, version))


def merge_stream(updates: DataFrame, base: str, checkpoint: str, order_col: str = "ord") -> None:
    """Merge everything that a stream has, one version a micro-batch."""
    (updates.writeStream.foreachBatch(lambda batch, k: merge(batch, base, k + 1, order_col))
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
