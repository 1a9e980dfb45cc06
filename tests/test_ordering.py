"""Two-level ordering helpers equal the plain (single-task) windows, also
with one key holding a third of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplytics.operators import ordering


def _frame(spark):
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{i % 37}"
        rows.append((g, (i * 7919) % 1000, i, i % 5))
    return spark.createDataFrame(rows, "g string, t int, id int, v int")


def test_running_sum_and_row_number(spark):
    df = _frame(spark)
    got = ordering.running_sum(df, ["t", "id"], "v", "s", inclusive=False, n_parts=7)
    w = Window.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert sorted(got.select("id", "s").collect()) == sorted(want.select("id", "s").collect())
    rn = ordering.row_number(df, ["t", "id"], "rn", n_parts=5)
    want_rn = df.withColumn("rn", F.row_number().over(Window.orderBy("t", "id")))
    assert sorted(rn.select("id", "rn").collect()) == sorted(want_rn.select("id", "rn").collect())


def test_group_row_number_hot_group(spark):
    df = _frame(spark)
    got = ordering.group_row_number(df, ["g"], ["t", "id"], "rn", n_parts=6)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")))
    assert sorted(got.select("id", "rn").collect()) == sorted(want.select("id", "rn").collect())


def test_group_lag_hot_group(spark):
    df = _frame(spark)
    got = ordering.group_lag(df, ["g"], ["t", "id"], "v", "prev", n_parts=6)
    want = df.withColumn("prev", F.lag("v").over(Window.partitionBy("g").orderBy("t", "id")))
    assert sorted(got.select("id", "prev").collect()) == sorted(want.select("id", "prev").collect())


def test_hot_group_spans_several_range_partitions(spark):
    df = _frame(spark)
    staged = ordering._range_parts(df, ["g", "t", "id"], 6)
    parts = staged.filter(F.col("g") == "hot").select(ordering._PART).distinct().count()
    assert parts > 1


def test_group_running_sum(spark):
    df = _frame(spark)
    got = ordering.group_running_sum(df, ["g"], ["t", "id"], "v", "s", n_parts=5)
    w = Window.partitionBy("g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum("v").over(w))
    assert sorted(got.select("id", "s").collect()) == sorted(want.select("id", "s").collect())


def test_rows_of_a_group_without_a_key_stay(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (1, 5), (None, 2), (1, 4)], "g long, v long")
    rn = ordering.group_row_number(df, ["g"], ["v"], "n", n_parts=3)
    assert sorted((r.g or 0, r.v, r.n) for r in rn.collect()) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 4, 1), (1, 5, 2)]
    lag = ordering.group_lag(df, ["g"], ["v"], "v", "p", n_parts=3)
    assert sorted((r.g or 0, r.v, r.p) for r in lag.collect()) == [(0, 1, None), (0, 2, 1), (0, 3, 2), (1, 4, None), (1, 5, 4)]
    total = ordering.group_running_sum(df, ["g"], ["v"], "v", "s", n_parts=3)
    assert sorted((r.g or 0, r.v, r.s) for r in total.collect()) == [(0, 1, 1), (0, 2, 3), (0, 3, 6), (1, 4, 4), (1, 5, 9)]
