"""Registered basket queries (W1, U6, U7, J1, A9, ST8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplytics.operators import basket as bk
from shoplytics.operators import catalog as cat
from shoplytics.plans.registry import register
from shoplytics.sources import bindings

# Oracle pieces: basket actions, effective actions, and the catalog prices
# (price band over the whole part table, as ``catalog_priced`` computes it).
_ACTIONS_SQL = f"""
actions AS (
  SELECT user_id AS shopper, json_extract_string(props, '$.k') AS item, ts, event_id,
         CASE event_type WHEN '{bindings.BASKET_ADD}' THEN 'add' ELSE 'remove' END AS action
  FROM events
  WHERE event_type IN ('{bindings.BASKET_ADD}', '{bindings.BASKET_REMOVE}')
    AND json_extract_string(props, '$.k') IS NOT NULL),
ids AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id FROM part),
effective AS (
  SELECT * FROM actions a WHERE action = 'remove' OR EXISTS (SELECT 1 FROM ids WHERE ids.id = a.item)),
members AS (
  SELECT shopper, item FROM effective GROUP BY shopper, item
  HAVING arg_max(action, (ts, event_id)) = 'add'),
priced AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, round(p_retailprice, 2) AS retail_price,
         CAST(trunc((p_size + {bindings.FAVS_OFFSET} - mn) / ((mx - mn + 1) / 2.0)) AS INTEGER) + 1
           AS price
  FROM part, (SELECT min(p_size + {bindings.FAVS_OFFSET}) AS mn,
                     max(p_size + {bindings.FAVS_OFFSET}) AS mx FROM part))
"""


def basket_actions(spark, sf_dir):
    ev = bindings.click_events(spark, sf_dir)
    return bk.basket_actions(ev, F.col("event_type") == bindings.BASKET_ADD,
                             F.col("event_type") == bindings.BASKET_REMOVE)


def catalog_priced(spark, sf_dir):
    """Catalog items with the price band (A3) and retail price."""
    items = bindings.catalog_items(spark, sf_dir)
    return cat.with_price(items).select("id", "price", "retail_price")


def effective_actions(spark, sf_dir):
    return bk.checked(basket_actions(spark, sf_dir),
                      bindings.catalog_items(spark, sf_dir).select("id"))


@register("basket_contents", ["W1", "U6", "U7", "J1", "A9", "C10"], bench=True, sql=f"""
WITH {_ACTIONS_SQL}
SELECT shopper, array_to_string(list_sort(list(item)), '|') AS items, count(*) AS n_items,
       CAST(sum(price) AS BIGINT) AS total, round(sum(retail_price), 2) AS retail_total
FROM members m LEFT JOIN priced p ON p.id = m.item
GROUP BY shopper
""")
def basket_contents(spark, sf_dir):
    """Every shopper's basket after all add / remove events: sorted item
    ids, count, price-band total and retail total."""
    members = bk.membership(effective_actions(spark, sf_dir))
    c = bk.contents(members, catalog_priced(spark, sf_dir))
    return c.select("shopper", F.array_join("items", "|").alias("items"), "n_items",
                    "total", "retail_total")


@register("basket_rejections", ["J1", "U7"], sql=f"""
WITH {_ACTIONS_SQL},
prev AS (SELECT *, lag(action) OVER (PARTITION BY shopper, item ORDER BY ts, event_id) AS prev_action
         FROM effective)
SELECT shopper, item, event_id, action, 'item_not_found' AS reason
FROM actions a WHERE action = 'add' AND NOT EXISTS (SELECT 1 FROM ids WHERE ids.id = a.item)
UNION ALL
SELECT shopper, item, event_id, action, 'not_in_basket'
FROM prev WHERE action = 'remove' AND coalesce(prev_action <> 'add', true)
""")
def basket_rejections(spark, sf_dir):
    """Basket requests that are rejected: adds of items without a catalog
    document, removes of items not in the basket at the time."""
    actions = basket_actions(spark, sf_dir)
    ids = bindings.catalog_items(spark, sf_dir).select("id")
    bad_adds = bk.rejected_adds(actions, ids)
    bad_removes = bk.rejected_removes(bk.checked(actions, ids))
    cols = ["shopper", "item", "event_id", "action", "reason"]
    return bad_adds.select(*cols).unionByName(bad_removes.select(*cols))


@register("basket_state_stream", ["ST8", "W1"], sql=f"""
WITH {_ACTIONS_SQL}
SELECT shopper, array_to_string(list_sort(list(item)), '|') AS items,
       CAST(count(*) AS INTEGER) AS n_items
FROM members GROUP BY shopper
""")
def basket_state_stream(spark, sf_dir):
    """The basket as a stateful stream (state per shopper) over the event
    files, final state read back from the per-batch update table."""
    from shoplytics.streaming.basket import basket_state_stream as run
    return run(spark, sf_dir)
