"""Harvest files and the category configuration.

Harvested photos are JSON lines, one file (or folder) per category.  They are
read with a declared schema (no inference pass over the data).  The category
comes from the partition folder when the files were written by
:func:`write_harvest`, else from the file name without extension.  The file
order given by the caller decides which copy of a photo is newest when
catalogs are merged (``file_pos``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytics.functions.urls import basename_without_extension
from shoplytics.sources.schemas import HARVEST_RECORD


def read_harvest(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """All harvest files as one DataFrame with ``category`` and
    ``file_pos`` (position of the file's path in ``paths``)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    # Listed recursively, without partition discovery: that allows one root only.
    df = (spark.read.schema(HARVEST_RECORD).option("recursiveFileLookup", "true").json(paths))
    fname = F.col("_metadata.file_path")
    named = F.regexp_extract(fname, "/category=([^/]+)/", 1)  # encoded as a path, and as a folder name
    df = df.withColumn("category", F.when(named != "", _decoded(_decoded(named)))
                       .otherwise(basename_without_extension(fname)))
    # The given file, or the folder above, that a row's file stands for.
    where = F.map_from_arrays(F.array(*[F.lit(_qualified(spark, p)) for p in paths]),
                              F.array(*[F.lit(i) for i in range(len(paths))]))
    parts = F.split(F.regexp_replace(fname, "^([a-z0-9]+):/+", "$1:/"), "/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
                        lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    found = F.array_compact(F.transform(above, lambda a: F.try_element_at(where, a)))
    return df.withColumn("file_pos", F.get(found, F.lit(0)))


def _decoded(name):
    plain = F.replace(name, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(plain), name)


def _qualified(spark: SparkSession, path: str) -> str:
    """The full name of a path, as Spark names files (one slash after the scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p)
    return re.sub("^([a-z0-9]+):/+", r"\1:/", full.toUri().toString())


def write_harvest(photos: DataFrame, dest: str, by: tuple[str, ...] = ("category",)) -> None:
    """One JSON-lines folder per category (``category=<name>``)."""
    photos.write.mode("overwrite").partitionBy(*by).json(dest)


def category_config(spark: SparkSession, text: str) -> DataFrame:
    """The category / keyword YAML as a small dimension table
    (category, keyword, keyword_pos), one row per keyword.  The file is a
    handful of lines, parsed once on the driver."""
    import yaml

    doc = yaml.safe_load(text) or {}
    rows = []
    for cat_pos, entry in enumerate(doc.get("categories") or []):
        for name, conf in entry.items():
            for kw_pos, kw in enumerate((conf or {}).get("keywords") or []):
                rows.append((cat_pos, str(name), kw_pos, str(kw)))
    return spark.createDataFrame(
        rows, "category_pos int, category string, keyword_pos int, keyword string")
