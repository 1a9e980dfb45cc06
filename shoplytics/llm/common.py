"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytics.session import checkpoint_dir

#: A word: a run of anything but space and the ASCII controls tab to return.
WORD = r"[^\x20\x09-\x0D]+"


def plain(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns named _p0, _p1, ... and the new names of ``names``, found
    by exact spelling, or else by any case.  So no extra column can clash with one that an
    operator uses or adds - not even one that differs by case alone."""
    have = df.columns
    low = [c.lower() for c in have]
    missing = [n for n in names if n not in have and n.lower() not in low]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {have}")
    at = [have.index(n) if n in have else low.index(n.lower()) for n in names]
    return df.toDF(*[f"_p{i}" for i in range(len(have))]), [f"_p{i}" for i in at]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns ``names`` (see :func:`plain`)."""
    inner, at = plain(df, *names)
    return inner.select(*[F.col(c).alias(n) for c, n in zip(at, names)])


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: cuts the
    lineage, and a lost executor costs no recomputation of what came before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share(spark: SparkSession, rows: int, per_task: int) -> int:
    """Number of even parts of at most about ``per_task`` rows."""
    return max(1, -(-rows // per_task))


def row_hash(df: DataFrame, *seed: Column) -> Column:
    """A hash of a row's values (but for maps and variants, which have none)."""
    return F.xxhash64(*seed, *[c for c, t in df.dtypes if "map<" not in t and "variant" not in t])
