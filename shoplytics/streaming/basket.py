"""Baskets as a stateful stream (ST8).

State per shopper: for every item touched, its last effective action and
that action's event order ``(ts_us, event_id)``.  Each micro-batch folds in
its events with "the later event wins" per item, vectorised in pandas, so
the result is the same for any split into batches and any arrival order, and
equals the batch job (``operators.basket.membership``).  The state grows with
the distinct items a shopper touched (bounded by the catalog), not with the
number of events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shoplytics.functions.times import epoch_micros
from shoplytics.operators import basket as bk
from shoplytics.sources import bindings
from shoplytics.streaming import runner
from shoplytics.streaming.traffic import event_table_stream

STATE_SCHEMA = ("entries array<struct<item:string,action:string,ts_us:bigint,event_id:bigint>>")
OUTPUT_SCHEMA = "shopper bigint, items string, n_items int"
_COLS = ["item", "action", "ts_us", "event_id"]


def fold_basket(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge this batch's basket actions of one shopper into its state, Arrow
    batch by Arrow batch: only the last action per item is held, however many
    actions the trigger brings."""
    latest = pd.DataFrame(list(state.get[0]) if state.exists else [], columns=_COLS)
    for chunk in chunks:
        latest = (pd.concat([latest, chunk[_COLS]], ignore_index=True)
                    .sort_values(["ts_us", "event_id"], kind="stable")
                    .drop_duplicates("item", keep="last"))
    state.update(([tuple(r) for r in latest[_COLS].itertuples(index=False, name=None)],))
    members = sorted(latest.loc[latest["action"] == bk.ADD, "item"])
    yield pd.DataFrame({"shopper": [key[0]], "items": ["|".join(members)],
                        "n_items": [len(members)]})


def basket_updates(actions: DataFrame) -> DataFrame:
    """Stateful per-shopper fold of effective basket actions (update mode)."""
    return (actions.select("shopper", "item", "action",
                           epoch_micros("ts").alias("ts_us"),
                           "event_id")
                   .groupBy("shopper")
                   .applyInPandasWithState(fold_basket, OUTPUT_SCHEMA, STATE_SCHEMA,
                                           "update", GroupStateTimeout.NoTimeout))


def basket_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = event_table_stream(spark, sf_dir)
    ev = src.select("event_id", "ts", F.col("user_id").alias("shopper"), "event_type",
                    bindings.product_id().alias("item"))
    actions = bk.basket_actions(ev, F.col("event_type") == bindings.BASKET_ADD,
                                F.col("event_type") == bindings.BASKET_REMOVE)
    # Stream-static semi join against the catalog ids.
    effective = bk.checked(actions, bindings.catalog_items(spark, sf_dir).select("id"))
    out = runner.scratch(spark, "basket-state")
    res = runner.run_to_table(effective, basket_updates, ["shopper"],
                              out + "/data", out + "/ckpt")
    return res.filter(F.col("n_items") > 0).select("shopper", "items", "n_items")
