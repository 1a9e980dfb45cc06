"""Registered top-pick queries (F1, F2, A2, A11, A12, J2, J6, J10, T2-T6,
T10, W2, W4, U4, U5, C8, C9, ST6, ST7, ST11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplytics.functions.random import beta_sql, permuted_sql
from shoplytics.operators import toppick as tp
from shoplytics.operators import mapping
from shoplytics.plans import mapping as pm
from shoplytics.plans.registry import REGISTRY, register
from shoplytics.sources import bindings

SEED = 7

_FLAGGED_SQL = f"""
  SELECT event_id, ts, json_extract_string(props, '$.k') AS item,
         event_type = '{bindings.TOP_PICK_CLICK}' AS is_click,
         event_type = '{bindings.TOP_PICK_IMPRESSION}' AS is_imp
  FROM events
  WHERE event_type IN ('{bindings.TOP_PICK_CLICK}', '{bindings.TOP_PICK_IMPRESSION}')
"""

_TALLY_SQL = f"""
SELECT item, count(*) FILTER (WHERE is_click) AS clicks,
       count(*) FILTER (WHERE is_imp) AS impressions
FROM ({_FLAGGED_SQL}) f GROUP BY item
"""

_A = "(clicks + 1)"
_B = "(greatest(impressions - clicks, 0) + 1)"


def flagged_events(spark, sf_dir):
    ev = bindings.click_events(spark, sf_dir)
    return tp.classify(ev, F.col("event_type") == bindings.TOP_PICK_CLICK,
                       F.col("event_type") == bindings.TOP_PICK_IMPRESSION)


def _draws(spark, sf_dir):
    t = tp.tallies(flagged_events(spark, sf_dir))
    return tp.draw(tp.posterior_mean(t), SEED, F.col("item"))


@register("toppick_tallies", ["A2", "A12"], sql=_TALLY_SQL)
def toppick_tallies(spark, sf_dir):
    """Clicks and impressions per item over the whole event table."""
    return tp.tallies(flagged_events(spark, sf_dir))


@register("toppick_tallies_merge", ["J10"], sql=_TALLY_SQL)
def toppick_tallies_merge(spark, sf_dir):
    """Same tally as a full outer merge of the two counters."""
    return tp.tallies_merged(flagged_events(spark, sf_dir))


@register("toppick_draws", ["T2", "T10", "W2", "C8", "C9"], bench=True, sql=f"""
WITH t AS ({_TALLY_SQL}),
d AS (SELECT *, {_A} / ({_A} + {_B}) AS mean,
             {beta_sql(str(SEED), 'item', _A, _B)} AS theta FROM t)
SELECT item, clicks, impressions, round(mean, 6) AS mean, round(theta, 6) AS theta,
       row_number() OVER (ORDER BY theta DESC, item) AS rank
FROM d
""")
def toppick_draws(spark, sf_dir):
    """Thompson draw and posterior mean per item, ranked by draw."""
    d = tp.rank_global(_draws(spark, sf_dir))
    return d.select("item", "clicks", "impressions", F.round("mean", 6).alias("mean"),
                    F.round("theta", 6).alias("theta"), "rank")


@register("toppick_winner", ["T2", "J2"], sql=f"""
WITH t AS ({_TALLY_SQL}),
d AS (SELECT item, {beta_sql(str(SEED), 'item', _A, _B)} AS theta FROM t),
w AS (SELECT * FROM d ORDER BY theta DESC, item LIMIT 1)
SELECT w.item, round(w.theta, 6) AS theta, p.p_name AS title,
       round(p.p_retailprice, 2) AS retail_price
FROM w LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = w.item
""")
def toppick_winner(spark, sf_dir):
    """The current winner and its catalog item (none when nothing is tallied)."""
    w = tp.winner(_draws(spark, sf_dir)).select("item", "theta")
    cat = bindings.catalog_items(spark, sf_dir).select(
        F.col("id").alias("item"), "title", "retail_price")
    # The winner's id as a scalar goes to the catalog scan, which leaves one row on either side.
    return (w.join(cat.filter(F.col("item") == w.select("item").scalar()), "item", "left")
            .select("item", F.round("theta", 6).alias("theta"), "title", "retail_price"))


_EPOCH_SQL = f"""
  SELECT *, floor(prior / {tp.IMPRESSIONS_PER_EPOCH})::BIGINT AS epoch,
         ((prior + is_imp::INT) % {tp.IMPRESSIONS_PER_EPOCH} + 1)::INT AS counter,
         is_imp AND (prior + is_imp::INT) % {tp.IMPRESSIONS_PER_EPOCH} = 0 AS refresh
  FROM (SELECT *, CAST(coalesce(sum(is_imp::INT) OVER (ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior
        FROM ({_FLAGGED_SQL}) f) x
"""


def _epochs(spark, sf_dir):
    return tp.assign_epochs(flagged_events(spark, sf_dir), ["ts", "event_id"])


@register("toppick_epochs", ["T4", "W4", "A11"], bench=True, sql=f"""
SELECT event_id, item, is_imp, prior AS prior_impressions, epoch, counter, refresh
FROM ({_EPOCH_SQL}) e
""")
def toppick_epochs(spark, sf_dir):
    """Experiment epoch, running impression count and counter of every
    top-pick event."""
    return _epochs(spark, sf_dir).select(
        "event_id", "item", "is_imp", "prior_impressions", "epoch", "counter", "refresh")


_EPOCH_TALLY_SQL = f"""
SELECT epoch, item, count(*) FILTER (WHERE is_click) AS clicks,
       count(*) FILTER (WHERE is_imp) AS impressions
FROM ({_EPOCH_SQL}) e GROUP BY epoch, item
"""


@register("toppick_epoch_tallies", ["A2", "T4"], sql=_EPOCH_TALLY_SQL)
def toppick_epoch_tallies(spark, sf_dir):
    """Clicks and impressions per (epoch, item)."""
    return tp.tallies(_epochs(spark, sf_dir), ("epoch", "item"))


def _key(col_epoch, col_item):
    return f"(CAST({col_epoch} AS VARCHAR) || ':' || {col_item})"


# Where an experiment's items come from: see ``bindings.experiment_item``.
_EXPERIMENT_SQL = _FLAGGED_SQL.replace("json_extract_string(props, '$.k') AS item", f"{bindings.experiment_item_sql()} AS item")
_EXPERIMENT_TALLY_SQL = f"""
SELECT epoch, item, count(*) FILTER (WHERE is_click) AS clicks,
       count(*) FILTER (WHERE is_imp) AS impressions
FROM ({_EPOCH_SQL.replace(_FLAGGED_SQL, _EXPERIMENT_SQL)}) e GROUP BY epoch, item
"""


def _refresh_sql(candidates: str) -> str:
    return f"""
WITH t AS ({_EXPERIMENT_TALLY_SQL}),
d AS (SELECT *, {beta_sql(str(SEED), _key('epoch', 'item'), _A, _B)} AS theta FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY theta DESC, item) AS rank,
             count(*) OVER (PARTITION BY epoch) AS n_items FROM d),
kept AS (SELECT * FROM r WHERE rank <= CASE WHEN n_items = 1 THEN 1 ELSE n_items // 2 END),
pos AS (SELECT CAST(p_partkey AS VARCHAR) AS id,
               row_number() OVER (ORDER BY md5('{SEED}|' || CAST(p_partkey AS VARCHAR)),
                                  CAST(p_partkey AS VARCHAR)) - 1 AS pos FROM part),
nc AS (SELECT count(*) AS n_cat FROM pos),
pe AS (SELECT epoch, count(*) AS kept, greatest({tp.NUM_ITEMS} - count(*), 0) AS n_random
       FROM kept GROUP BY epoch),
pe2 AS (SELECT pe.*, n_cat, least({candidates}, n_cat) AS m FROM pe, nc),
slots AS (SELECT epoch, n_random, j, {permuted_sql('j', 'n_cat', repr(str(SEED)), "'fill'", 'epoch')} AS pos
          FROM pe2, LATERAL (SELECT unnest(range(0, m)) AS j) s WHERE m > 0 AND n_random > 0),
cands AS (SELECT s.epoch, s.j, s.n_random, p.id AS item FROM slots s JOIN pos p USING (pos)),
fresh AS (SELECT * FROM cands c WHERE NOT EXISTS
            (SELECT 1 FROM kept k WHERE k.epoch = c.epoch AND k.item = c.item)),
fill AS (SELECT epoch, item, row_number() OVER (PARTITION BY epoch ORDER BY j) AS k, n_random
         FROM fresh)
SELECT epoch + 1 AS next_epoch, item, 'kept' AS role, CAST(rank AS INTEGER) AS slot,
       1::BIGINT AS clicks, 1::BIGINT AS impressions FROM kept
UNION ALL
SELECT epoch + 1, item, 'random', CAST(k AS INTEGER), 1::BIGINT, 1::BIGINT FROM fill WHERE k <= n_random
"""


def _refresh(spark, sf_dir, compat):
    """The refresh of every epoch, over top-pick events whose items come in fours."""
    ev = (flagged_events(spark, sf_dir).drop("item").withColumn("item", bindings.experiment_item()))
    et = tp.tallies(tp.assign_epochs(ev, ["ts", "event_id"]), ("epoch", "item"))
    kept = tp.keep_top(et, SEED)
    positions = tp.catalog_positions(bindings.catalog_items(spark, sf_dir).select("id"), SEED)
    return tp.refresh(kept, positions, SEED, compat)


@register("toppick_refresh", ["T3", "T5", "T6", "J6", "U4", "U5", "W2"], sql=_refresh_sql("n_random + kept"))
def toppick_refresh(spark, sf_dir):
    """The refresh step applied to every epoch's tally: keep the best half by
    draw, fill up to four with random catalog items not kept, and seed the
    next experiment at 1 / 1."""
    return _refresh(spark, sf_dir, compat=False)


@register("toppick_refresh_compat", ["T5", "J6", "U4", "U5"], sql=_refresh_sql("2 * n_random"))
def toppick_refresh_compat(spark, sf_dir):
    """The refresh step as the reference draws it: only ``2 * n`` random
    candidates, so an experiment can come up short when candidates overlap
    the kept items."""
    return _refresh(spark, sf_dir, compat=True)


def _stream_state(spark, sf_dir):
    from shoplytics.streaming import runner
    from shoplytics.streaming import toppick as stp
    root = runner.scratch(spark, "toppick")
    handler = stp.TopPickStream(root, bindings.catalog_items(spark, sf_dir).select("id"), SEED)
    stp.run(stp.flagged_stream(spark, sf_dir), handler, root + "/ckpt")
    return root, stp.latest_state(spark, root)


@register("toppick_stream_state", ["ST6", "ST11", "T3", "T4", "T5", "T6", "A11"])
def toppick_stream_state(spark, sf_dir):
    """The experiment after the event stream: items of the current
    experiment with their running tallies (sequential refresh chain)."""
    _, state = _stream_state(spark, sf_dir)
    return state.select("epoch", "item", "clicks", "impressions")


@register("toppick_stream_winner", ["ST7", "T2", "J2"])
def toppick_stream_winner(spark, sf_dir):
    """The home-page pick served from the streamed experiment state."""
    from shoplytics.streaming import toppick as stp
    _, state = _stream_state(spark, sf_dir)
    cat = bindings.catalog_items(spark, sf_dir).select("id", "title", "retail_price")
    return stp.serve(state, cat, SEED).select("item", F.round("theta", 6).alias("theta"),
                                              "title", "retail_price")


@register("toppick_home_views", ["F3", "ST7", "J2", "T2", "T4"], sql=f"""
WITH e AS (
  SELECT event_id, ts, item, is_click, is_imp, false AS is_view FROM ({_EXPERIMENT_SQL}) f WHERE item IS NOT NULL
  UNION ALL
  SELECT event_id, ts, NULL, false, false, true FROM events WHERE event_type = '{bindings.HOME_VIEW}'),
ep AS (
  SELECT *, coalesce(sum(is_imp::INT) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
            // {tp.IMPRESSIONS_PER_EPOCH} AS epoch FROM e),
told AS (
  SELECT v.event_id, t.item, count(*) FILTER (WHERE t.is_click) AS clicks, count(*) FILTER (WHERE t.is_imp) AS impressions
  FROM ep v JOIN ep t ON v.epoch = t.epoch AND (t.ts < v.ts OR (t.ts = v.ts AND t.event_id < v.event_id))
  WHERE v.is_view AND NOT t.is_view GROUP BY v.event_id, t.item),
d AS (SELECT *, {beta_sql(str(SEED), "(CAST(event_id AS VARCHAR) || ':' || item)", _A, _B)} AS theta FROM told),
best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY theta DESC, item) AS r FROM d)
SELECT ep.event_id, ep.epoch, best.item, round(theta, 6) AS theta, clicks, impressions, p_name AS title
FROM ep LEFT JOIN best ON best.event_id = ep.event_id AND r = 1
LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = best.item WHERE is_view
""")
def toppick_home_views(spark, sf_dir):
    """The home page's pick for every home view, drawn from the tallies of its
    experiment as they stood then, with the catalog item (null before the first tally)."""
    ev = bindings.click_events(spark, sf_dir)
    flagged = flagged_events(spark, sf_dir).drop("item").withColumn("item", bindings.experiment_item())
    views = ev.filter(F.col("event_type") == bindings.HOME_VIEW).select("ts", "event_id")
    picks = tp.home_picks(flagged, views, ["ts", "event_id"], SEED)
    titles = bindings.catalog_items(spark, sf_dir).select(F.col("id").alias("item"), "title")
    return picks.join(titles, "item", "left").select(
        "event_id", "epoch", "item", F.round("theta", 6).alias("theta"), "clicks", "impressions", "title")


@register("toppick_event_kinds", ["F1", "F2", "F3"], sql=f"""
WITH e AS (
  SELECT 'page ' || page_id AS id, 'pageView' AS "eventType", "pageType", source FROM ({REGISTRY["map_page_locations"].sql}) p
  UNION ALL
  SELECT 'event ' || "eventId", "eventType", "pageType", source FROM ({REGISTRY["map_click_events"].sql}) c)
SELECT id, CASE WHEN source = 'top_pick' AND "eventType" = 'pageView' THEN 'click'
                WHEN source = 'top_pick' AND "eventType" = 'impression' THEN 'impression'
                WHEN "pageType" = 'home' THEN 'home' ELSE 'none' END AS kind FROM e
""")
def toppick_event_kinds(spark, sf_dir):
    """Every mapped page view and click event, told by the consumer's predicates:
    top-pick click, top-pick impression, home view or none of them."""
    pages = bindings.page_locations(spark, sf_dir).select(
        "page_id", "location", F.lit(mapping.PAGE_VIEW).alias("eventType"))
    views = mapping.map_events(pages, routes=pm.PAGE_ROUTES, keep=("page_id",)).withColumn(
        "id", F.concat(F.lit("page "), F.col("page_id").cast("string")))
    events = mapping.map_events(bindings.raw_shop_events(spark, sf_dir)).withColumn(
        "id", F.concat(F.lit("event "), F.col("eventId")))
    fields = ["id", "eventType", "pageType", "source"]
    return views.select(fields).unionByName(events.select(fields)).select("id", tp.event_kind().alias("kind"))
