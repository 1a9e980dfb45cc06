"""Baskets folded from add / remove events.

A basket is a set of item ids per shopper (item identity = id).  Adding an
item that is not in the catalog is rejected; adding an item already in the
basket changes nothing (set add); removing an item that is not in the basket
is rejected.  Hence an item is in the basket at the end exactly when the
last *effective* action on (shopper, item) - a catalog-checked add, or a
remove - is an add.  That is one hash aggregate (``max_by`` on event order),
which combines partially on the map side: a hot (shopper, item) never sorts
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplytics.operators import ordering

ADD = "add"
REMOVE = "remove"


def basket_actions(events: DataFrame, add: Column, remove: Column) -> DataFrame:
    """(shopper, item, ts, event_id, action) for basket events."""
    # The raw predicates first: they reach the Parquet scan as pushed filters.
    return (events.filter(add | remove)
                  .withColumn("action", F.when(add, F.lit(ADD)).when(remove, F.lit(REMOVE)))
                  .filter(F.col("action").isNotNull() & F.col("item").isNotNull())
                  .select("shopper", "item", "ts", "event_id", "action"))


def checked(actions: DataFrame, catalog_ids: DataFrame) -> DataFrame:
    """Adds of an item with a catalog document are effective (inner
    equi-join); ``rejected_adds`` has the others (``left_anti``)."""
    ids = catalog_ids.select(F.col("id").alias("item")).distinct()
    adds = actions.filter(F.col("action") == ADD).join(ids, "item", "left_semi")
    return adds.unionByName(actions.filter(F.col("action") == REMOVE))


def rejected_adds(actions: DataFrame, catalog_ids: DataFrame) -> DataFrame:
    ids = catalog_ids.select(F.col("id").alias("item")).distinct()
    return (actions.filter(F.col("action") == ADD).join(ids, "item", "left_anti")
                   .withColumn("reason", F.lit("item_not_found")))


def rejected_removes(effective: DataFrame) -> DataFrame:
    """A remove is rejected when the item is not in the basket at that
    moment, i.e. the previous effective action on (shopper, item) is not an
    add.  The previous action is a two-level lag (no group in one task)."""
    prev = ordering.group_lag(effective, ["shopper", "item"], ["ts", "event_id"],
                              "action", "prev_action")
    return (prev.filter((F.col("action") == REMOVE)
                        & ~F.coalesce(F.col("prev_action") == ADD, F.lit(False)))
                .drop("prev_action").withColumn("reason", F.lit("not_in_basket")))


def membership(effective: DataFrame) -> DataFrame:
    """(shopper, item) pairs in the basket after all events."""
    last = effective.groupBy("shopper", "item").agg(
        F.max_by("action", F.struct("ts", "event_id")).alias("last"))
    return last.filter(F.col("last") == ADD).select("shopper", "item")


def contents(members: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Per shopper the sorted item ids, item count and price totals.
    A basket holds distinct catalog items, so the array is bounded by the
    catalog size."""
    m = members
    aggs = [F.array_sort(F.collect_list("item")).alias("items"),
            F.count(F.lit(1)).alias("n_items")]
    if prices is not None:
        m = m.join(prices.withColumnRenamed("id", "item"), "item", "left")
        aggs += [F.sum("price").alias("total"),
                 F.round(F.sum("retail_price"), 2).alias("retail_total")]
    return m.groupBy("shopper").agg(*aggs)
