"""Reading the input tables.

Every job reads through :func:`table`, which returns a lazily evaluated
DataFrame over ``<dir>/<name>.parquet``.  Column pruning and predicate
pushdown are left to Catalyst: jobs select what they need and the Parquet scan
only reads those columns (``ReadSchema`` in ``explain``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register each input table as a temp view of the same name (for SQL)."""
    for name in names:
        p = table_path(sf_dir, name)
        if os.path.exists(p):
            spark.read.parquet(p).createOrReplaceTempView(name)
