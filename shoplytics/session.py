"""SparkSession construction and shared-folder helpers.

Cluster settings (master, shuffle partitions, checkpoint folder) are read from
the session when they are already set; defaults are applied only where they are
unset, which is the local/test case.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins and coalesces shuffle
# partitions at runtime; skew-join splitting protects against a hot key.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Checkpoint files go when the data that they hold is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
    # Broadcast only below this size (bytes); bigger sides use a shuffle join.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(app: str = "shoplytics", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one with our defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[*]")
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` as configured by the cluster.  Only when it
    is unset (local runs, tests) is a fresh local folder created and
    registered with the SparkContext.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        spark.sparkContext.setCheckpointDir(conf)
        return conf
    if not spark.sparkContext.master.startswith("local"):
        # A machine-local folder is not visible to other executors.
        raise RuntimeError("spark.checkpoint.dir is not set: point it at a shared folder "
                           "(distributed file system or object store) the cluster can read")
    local = tempfile.mkdtemp(prefix="shoplytics-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of the queries run inside go when a query ends, not when the driver happens to
    collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder (unique by
    construction, so it works the same on a distributed file system or an
    object store, where a local existence check would see nothing)."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """``df`` written to a fresh table of the shared folder, in folders by ``by``, and read back; its
    shuffles hold no disk any more."""
    path = scratch(df.sparkSession, name)
    append(df, path, by, **options)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a :func:`scratch` folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def append(df: DataFrame, path: str, by: tuple[str, ...] = (), **options: str) -> None:
    with shuffles_freed(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").options(**options).partitionBy(*by).parquet(path)


_SHIPPED = "spark.shoplytics.pyfiles"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per session.

    Functions handed to pandas UDFs, ``mapInPandas`` and
    ``applyInPandasWithState`` are unpickled on the executors, which import
    ``shoplytics`` there.  The package sources are zipped on the driver and
    distributed with ``addPyFile`` (Spark's own code shipping: the driver
    serves the file and every executor fetches its own copy; no executor
    reads the driver's folder), so the jobs run wherever the driver was
    started from."""
    if spark.conf.get(_SHIPPED, "") == "yes":
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="shoplytics-pyfiles-"), "shoplytics.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(out)
    spark.conf.set(_SHIPPED, "yes")
