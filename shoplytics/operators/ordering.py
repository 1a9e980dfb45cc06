"""Global running counts and row numbers without a single-task window.

``Window.orderBy(...)`` with no partition moves every row into one task.
These helpers compute the same values in two levels:

1. range-partition the rows on the order key (sampled bounds, so a hot
   value of the leading column is split by the trailing unique columns),
2. total each range partition - one row per partition, a size bound that
   is the partition count, not the data - and prefix-sum those totals,
3. run the window inside each range partition and add the broadcast offset.

The order key must be unique (end it with an id column) for the result to be
deterministic.

The range-partitioned rows are checkpointed (reliable checkpoint in the
cluster's ``spark.checkpoint.dir``) before they are used twice.  Range bounds
come from a sample whose seed depends on the RDD, so two independent
evaluations of the same range shuffle can place a row in different
partitions; materialising the partition id once makes the totals and the
in-partition window agree, and survives executor loss.  The input rows are
materialised as given, so callers pass narrow projections (keys, order
columns and the few values they carry), not wide records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplytics.session import checkpoint_dir

_PART = "__range_part"


def _range_parts(df: DataFrame, order_cols: list[str], n_parts: int | None) -> DataFrame:
    """Range-partition on the order columns and pin each row's partition id.
    Without an explicit count AQE sizes the ranges from the data (it only
    merges adjacent ranges, so partition ids stay in key order)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    staged = (df.repartitionByRange(n_parts, *order_cols) if n_parts
              else df.repartitionByRange(*order_cols))
    return staged.withColumn(_PART, F.spark_partition_id()).checkpoint(eager=True)


def running_sum(df: DataFrame, order_cols: list[str], value, out_col: str,
                inclusive: bool = True, n_parts: int | None = None) -> DataFrame:
    """``out_col`` = sum of ``value`` over all rows up to this one (or strictly
    before it when ``inclusive`` is False) in global ``order_cols`` order."""
    val = F.col(value) if isinstance(value, str) else value
    r = _range_parts(df.withColumn("__v", val.cast("long")), order_cols, n_parts)
    totals = r.groupBy(_PART).agg(F.sum("__v").alias("__ptotal"))
    # One row per range partition: this window is bounded by the partition count.
    offsets = totals.select(
        _PART,
        F.coalesce(F.sum("__ptotal").over(
            Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("__offset"))
    w = Window.partitionBy(_PART).orderBy(*order_cols)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = r.withColumn("__local", F.coalesce(F.sum("__v").over(frame), F.lit(0)))
    return (local.join(F.broadcast(offsets), _PART)
                 .withColumn(out_col, F.col("__local") + F.col("__offset"))
                 .drop(_PART, "__v", "__local", "__offset"))


def row_number(df: DataFrame, order_cols: list[str], out_col: str = "rn",
               n_parts: int | None = None) -> DataFrame:
    """1-based global row number in ``order_cols`` order."""
    return running_sum(df, order_cols, F.lit(1), out_col, inclusive=True, n_parts=n_parts)


def _to_rows(rows: DataFrame, pieces: DataFrame, group_cols: list[str]) -> DataFrame:
    """A piece's columns joined to its rows; a null in a group column is a group like any other."""
    named = pieces.withColumnsRenamed({c: f"__of_{c}" for c in (_PART, *group_cols)})
    same = F.col(_PART) == F.col(f"__of_{_PART}")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return rows.join(named, same).drop(*[f"__of_{c}" for c in (_PART, *group_cols)])


def group_row_number(df: DataFrame, group_cols: list[str], order_cols: list[str],
                     out_col: str = "rn", n_parts: int | None = None) -> DataFrame:
    """1-based row number inside each group, in ``order_cols`` order, without
    moving a whole group into one task.

    Rows are range-partitioned on (group, order): a hot group spans several
    range partitions.  Each partition counts its rows per group (one row per
    (partition, group) piece), the pieces of a group are prefix-summed in
    partition order, and the in-partition row number gets that offset.  The
    piece table has at most ``#groups + #partitions`` rows, so its window is
    cheap; its join back is left to AQE (broadcast when it is small)."""
    keys = [*group_cols, *order_cols]
    r = _range_parts(df, keys, n_parts)
    pieces = r.groupBy(_PART, *group_cols).agg(F.count(F.lit(1)).alias("__ptotal"))
    offsets = pieces.select(
        _PART, *group_cols,
        F.coalesce(F.sum("__ptotal").over(
            Window.partitionBy(*group_cols).orderBy(_PART)
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    local = r.withColumn("__local", F.row_number().over(
        Window.partitionBy(_PART, *group_cols).orderBy(*order_cols)))
    return (_to_rows(local, offsets, group_cols)
                 .withColumn(out_col, F.col("__local") + F.col("__offset"))
                 .drop(_PART, "__local", "__offset"))


def stage(df: DataFrame, group_cols: list[str], order_cols: list[str],
          n_parts: int | None = None) -> DataFrame:
    """Range-partition once for several grouped two-level passes
    (:func:`staged_lag`, :func:`staged_running_sum`); drop :data:`PART` at
    the end with :func:`unstage`."""
    return _range_parts(df, [*group_cols, *order_cols], n_parts)


PART = _PART


def unstage(df: DataFrame) -> DataFrame:
    return df.drop(_PART)


def staged_lag(r: DataFrame, group_cols: list[str], order_cols: list[str], value,
               out_col: str) -> DataFrame:
    """``lag(value)`` per group on staged rows: plain ``lag`` inside a range
    partition; a group's first row in a partition takes the last value of
    the group's previous piece (``max_by`` per piece, ``lag`` over the small
    piece table)."""
    val = F.col(value) if isinstance(value, str) else value
    r = r.withColumn("__v", val)
    pieces = r.groupBy(_PART, *group_cols).agg(
        F.max_by("__v", F.struct(*order_cols)).alias("__last"))
    carry = pieces.select(
        _PART, *group_cols,
        F.lag("__last").over(Window.partitionBy(*group_cols).orderBy(_PART)).alias("__carry"))
    w = Window.partitionBy(_PART, *group_cols).orderBy(*order_cols)
    local = (r.withColumn("__lag", F.lag("__v").over(w))
              .withColumn("__first", F.row_number().over(w) == 1))
    return (_to_rows(local, carry, group_cols)
                 .withColumn(out_col, F.when(F.col("__first"), F.col("__carry"))
                             .otherwise(F.col("__lag")))
                 .drop("__v", "__lag", "__carry", "__first"))


def staged_running_sum(r: DataFrame, group_cols: list[str], order_cols: list[str], value,
                       out_col: str, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` per group on staged rows (piece totals
    prefix-summed per group, then an offset)."""
    val = F.col(value) if isinstance(value, str) else value
    r = r.withColumn("__v", val.cast("long"))
    pieces = r.groupBy(_PART, *group_cols).agg(F.sum("__v").alias("__ptotal"))
    offsets = pieces.select(
        _PART, *group_cols,
        F.coalesce(F.sum("__ptotal").over(
            Window.partitionBy(*group_cols).orderBy(_PART)
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    frame = (Window.partitionBy(_PART, *group_cols).orderBy(*order_cols)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = r.withColumn("__local", F.coalesce(F.sum("__v").over(frame), F.lit(0)))
    return (_to_rows(local, offsets, group_cols)
                 .withColumn(out_col, F.col("__local") + F.col("__offset"))
                 .drop("__v", "__local", "__offset"))


def group_lag(df: DataFrame, group_cols: list[str], order_cols: list[str], value,
              out_col: str, n_parts: int | None = None) -> DataFrame:
    """``lag(value)`` inside each group in ``order_cols`` order, in two levels."""
    r = stage(df, group_cols, order_cols, n_parts)
    return unstage(staged_lag(r, group_cols, order_cols, value, out_col))


def group_running_sum(df: DataFrame, group_cols: list[str], order_cols: list[str], value,
                      out_col: str, inclusive: bool = True,
                      n_parts: int | None = None) -> DataFrame:
    """Running sum of ``value`` inside each group in ``order_cols`` order,
    in two levels."""
    r = stage(df, group_cols, order_cols, n_parts)
    return unstage(staged_running_sum(r, group_cols, order_cols, value, out_col, inclusive))
