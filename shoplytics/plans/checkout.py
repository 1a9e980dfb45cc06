"""Registered checkout queries (C11, C15, J9, T8, ST9, ST10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplytics.functions.random import hash48_sql
from shoplytics.operators import checkout as co
from shoplytics.operators import search as se
from shoplytics.plans.basket import _ACTIONS_SQL, catalog_priced, effective_actions
from shoplytics.plans.registry import register
from shoplytics.plans.search import _fold_sql
from shoplytics.sources import bindings
from shoplytics.sources.tables import table

_FUNNEL_SQL = f"""
{_ACTIONS_SQL},
ev AS (SELECT user_id AS shopper, ts, event_type FROM events),
t0 AS (SELECT shopper, min(ts) AS basket_at FROM effective WHERE action = 'add' GROUP BY 1),
t1 AS (SELECT e.shopper, min(e.ts) AS email_at FROM ev e JOIN t0 USING (shopper)
       WHERE e.event_type = '{bindings.CHECKOUT_EMAIL}' AND e.ts > t0.basket_at GROUP BY 1),
t2 AS (SELECT e.shopper, min(e.ts) AS done_at FROM ev e JOIN t1 USING (shopper)
       WHERE e.event_type = '{bindings.CHECKOUT_DONE}' AND e.ts > t1.email_at GROUP BY 1),
snap_members AS (
  SELECT e.shopper, e.item FROM effective e JOIN t1 USING (shopper) WHERE e.ts <= t1.email_at
  GROUP BY e.shopper, e.item HAVING arg_max(e.action, (e.ts, e.event_id)) = 'add')
"""

_CHECKOUT_ID_SQL = ("md5(CAST(shopper AS VARCHAR)) || "
                    "CAST(CAST(floor(epoch_us({at}) / 1000) AS BIGINT) AS VARCHAR)")


def _shopper_hex():
    return F.md5(F.col("shopper").cast("string"))


def funnel(spark, sf_dir):
    ev = bindings.click_events(spark, sf_dir)
    eff = effective_actions(spark, sf_dir)
    emails = ev.filter(F.col("event_type") == bindings.CHECKOUT_EMAIL).select("shopper", "ts")
    done = ev.filter(F.col("event_type") == bindings.CHECKOUT_DONE).select("shopper", "ts")
    f = co.funnel(eff, emails, done)
    return co.with_checkout_id(f, _shopper_hex(), "email_at"), eff


@register("checkout_funnel", ["ST10", "C15"], sql=f"""
WITH {_FUNNEL_SQL}
SELECT shopper, basket_at, email_at, done_at,
       CASE WHEN done_at IS NOT NULL THEN 2 WHEN email_at IS NOT NULL THEN 1 ELSE 0 END
         AS furthest_step,
       CASE WHEN email_at IS NOT NULL THEN {_CHECKOUT_ID_SQL.format(at='email_at')} END AS checkout_id
FROM t0 LEFT JOIN t1 USING (shopper) LEFT JOIN t2 USING (shopper)
""")
def checkout_funnel(spark, sf_dir):
    """Per shopper with a basket: first basket add, first checkout e-mail
    after it, first completion after that, furthest step and checkout id."""
    f, _ = funnel(spark, sf_dir)
    return f.select("shopper", "basket_at", "email_at", "done_at", "furthest_step", "checkout_id")


def _snapshots(spark, sf_dir):
    f, eff = funnel(spark, sf_dir)
    opened = f.filter(F.col("email_at").isNotNull())
    snap = co.snapshots(co.basket_as_of(eff, opened, "email_at"), catalog_priced(spark, sf_dir))
    return opened, snap, eff


@register("checkout_tokens", ["T8", "A9"], sql=f"""
WITH {_FUNNEL_SQL},
snap AS (SELECT shopper, CAST(sum(price) AS BIGINT) AS n_tokens FROM snap_members m JOIN priced p ON p.id = m.item
         GROUP BY 1),
co AS (SELECT {_CHECKOUT_ID_SQL.format(at='email_at')} AS checkout_id, n_tokens
       FROM t1 JOIN snap USING (shopper)),
words AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM (
            SELECT DISTINCT unnest(regexp_extract_all({_fold_sql('text')}, '{se.TOKEN_PATTERN}')) AS word
            FROM benchmark) w),
nw AS (SELECT count(*) AS n FROM words),
draws AS (SELECT checkout_id, i, {hash48_sql('checkout_id', 'i')} % n AS idx
          FROM co, nw, LATERAL (SELECT unnest(range(1, n_tokens + 1)) AS i) s)
SELECT checkout_id, i, word FROM draws JOIN words USING (idx)
""")
def checkout_tokens(spark, sf_dir):
    """CAPTCHA tokens of every opened checkout: one word per price point of
    the basket at opening, drawn with replacement from the word list
    (distinct words of ``benchmark`` texts)."""
    opened, snap, _ = _snapshots(spark, sf_dir)
    checkouts = opened.select("shopper", "checkout_id").join(snap, "shopper")
    words = (table(spark, sf_dir, "benchmark")
             .select(F.explode(se.tokens("text")).alias("word")))
    return co.sample_tokens(checkouts, co.word_table(words))


@register("checkout_basket_changes", ["J9", "C14"], sql=f"""
WITH {_FUNNEL_SQL},
snap_items AS (SELECT shopper, array_to_string(list_sort(list(item)), '|') AS snapshot
               FROM snap_members GROUP BY 1),
cur AS (SELECT shopper, array_to_string(list_sort(list(item)), '|') AS "current"
        FROM members GROUP BY 1)
SELECT t1.shopper, s.snapshot, c."current",
       NOT (s.snapshot IS NOT DISTINCT FROM c."current") AS changed
FROM t1 LEFT JOIN snap_items s USING (shopper) LEFT JOIN cur c USING (shopper)
""")
def checkout_basket_changes(spark, sf_dir):
    """Opened checkouts joined to the shopper's basket now: changed when the
    sorted item ids differ (null-safe)."""
    from shoplytics.operators import basket as bk
    opened, snap, eff = _snapshots(spark, sf_dir)
    cur = bk.contents(bk.membership(eff)).select("shopper", F.col("items").alias("cur_items"))
    j = (opened.select("shopper").join(snap.select("shopper", "items"), "shopper", "left")
               .join(cur, "shopper", "left"))
    return j.select("shopper",
                    F.array_join("items", "|").alias("snapshot"),
                    F.array_join("cur_items", "|").alias("current"),
                    (~F.col("items").eqNullSafe(F.col("cur_items"))).alias("changed"))


@register("checkout_state_stream", ["ST9", "C15"])
def checkout_state_stream(spark, sf_dir):
    """The checkout state machine as a stateful stream per shopper (basket,
    in-flight checkout, completions, rejected requests)."""
    from shoplytics.streaming.checkout import checkout_state_stream as run
    return run(spark, sf_dir)


def _token_words(spark, sf_dir):
    return co.word_table(table(spark, sf_dir, "benchmark").select(F.explode(se.tokens("text")).alias("word")))


@register("checkout_records", ["ST9", "C11", "T8"])
def checkout_records(spark, sf_dir):
    """Every completed checkout of the event stream with its e-mail, basket and the
    digest of its tokens; completions with a wrong token response are none."""
    from shoplytics.streaming import checkout as sc
    words = _token_words(spark, sf_dir).checkpoint()
    done = sc.records(sc.checkout_records(spark, sf_dir, words))
    tokens = co.sample_tokens(done, words).groupBy("checkout_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "word"))).alias("tokens"))
    shown = F.array_join(F.transform(F.coalesce("tokens", F.array().cast("array<struct<i:int,word:string>>")), lambda x: x["word"]), " ")
    return done.join(tokens, "checkout_id", "left").select(
        "checkout_id", "shopper", "ts_ms", "email", "items", "n_tokens", F.md5(shown).alias("tokens_md5"))


@register("checkout_attempts", ["ST9", "C11"])
def checkout_attempts(spark, sf_dir):
    """Per shopper after the stream: checkouts completed, requests rejected, completions
    with wrong responses, and the step of the checkout in flight."""
    from shoplytics.streaming import checkout as sc
    rows = sc.checkout_records(spark, sf_dir, _token_words(spark, sf_dir).checkpoint())
    return sc.states(rows).select("shopper", "items", "step", "completed", "rejected", "wrong")
