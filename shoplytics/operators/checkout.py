"""Checkout: funnel, basket snapshots, CAPTCHA tokens (C11, C15, J9, T8, ST10).

A checkout is created when a shopper with a basket first opens it (here:
the first checkout-email event after the first effective basket add); its
id is the shopper id followed by the epoch milliseconds of that event (C15).
It holds one token per price point of the basket at that moment (T8).  Step
1 is the e-mail post, step 2 the accepted token responses (completed).

Everything here is hash aggregates and equi-joins on the shopper; the basket
"as of" a time is the last-action membership (W1) restricted to the actions
before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplytics.functions import random as R
from shoplytics.operators import basket as bk
from shoplytics.operators import ordering


def tokens_match(responses, tokens, compat: bool = False) -> Column:
    """C11: every given response equals the token at its position.  The
    default requires as many responses as tokens; ``compat`` accepts fewer
    (as the reference does) and yields NULL (an error) for more."""
    r = F.col(responses) if isinstance(responses, str) else responses
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    pairwise = F.forall(F.zip_with(r, F.slice(t, 1, F.greatest(F.size(r), F.lit(1))),
                                   lambda a, b: a.eqNullSafe(b)), lambda x: x)
    if compat:
        return F.when(F.size(r) > F.size(t), F.lit(None).cast("boolean")) \
                .when(F.size(r) == 0, F.lit(True)).otherwise(pairwise)
    return (F.size(r) == F.size(t)) & ((F.size(r) == 0) | pairwise)


def funnel(effective: DataFrame, emails: DataFrame, completions: DataFrame) -> DataFrame:
    """ST10: per shopper the first effective basket add, the first checkout
    e-mail after it and the first completion after that; the furthest step
    reached (0 basket, 1 e-mail, 2 completed).  Each stage is a partial /
    final ``min`` aggregate joined back on the shopper."""
    adds = effective.filter(F.col("action") == bk.ADD)
    t0 = adds.groupBy("shopper").agg(F.min("ts").alias("basket_at"))
    t1 = (emails.join(t0, "shopper").filter(F.col("ts") > F.col("basket_at"))
                .groupBy("shopper").agg(F.min("ts").alias("email_at")))
    t2 = (completions.join(t1, "shopper").filter(F.col("ts") > F.col("email_at"))
                     .groupBy("shopper").agg(F.min("ts").alias("done_at")))
    f = t0.join(t1, "shopper", "left").join(t2, "shopper", "left")
    step = (F.when(F.col("done_at").isNotNull(), F.lit(2))
             .when(F.col("email_at").isNotNull(), F.lit(1)).otherwise(F.lit(0)))
    return f.withColumn("furthest_step", step)


def basket_as_of(effective: DataFrame, at: DataFrame, at_col: str) -> DataFrame:
    """Basket members of each shopper in ``at`` at time ``at_col`` (actions
    at or before it): a filtered last-action aggregate."""
    before = (effective.join(at.select("shopper", at_col), "shopper")
                       .filter(F.col("ts") <= F.col(at_col)))
    return bk.membership(before)


def snapshots(members: DataFrame, prices: DataFrame) -> DataFrame:
    """Per shopper: sorted item ids and the token count (sum of price
    bands) of a basket."""
    return bk.contents(members, prices).select(
        "shopper", "items", F.col("total").alias("n_tokens"))


def with_checkout_id(df: DataFrame, shopper_hex: Column, at_col: str) -> DataFrame:
    from shoplytics.functions.ids import checkout_id
    return df.withColumn("checkout_id",
                         F.when(F.col(at_col).isNotNull(), checkout_id(shopper_hex, F.col(at_col))))


def word_table(words: DataFrame) -> DataFrame:
    """The token word list as (idx, word), idx in [0, n): distinct words in
    order, numbered by a two-level global row number."""
    distinct = words.select("word").distinct()
    return ordering.row_number(distinct, ["word"], "rn").select(
        (F.col("rn") - 1).alias("idx"), "word")


def sample_tokens(checkouts: DataFrame, words: DataFrame) -> DataFrame:
    """``n_tokens`` words per checkout, drawn with replacement; draw i
    is the word at ``hash(checkout_id, i) mod n`` (keyed, reproducible).
    One row per token via ``explode(sequence)``, then an equi-join on the
    word index (no cross join; AQE broadcasts the list when it is small)."""
    n = words.agg(F.count(F.lit(1))).scalar()
    draws = (checkouts.filter(F.col("n_tokens") > 0)
             .select("checkout_id", F.explode(F.sequence(F.lit(1), F.col("n_tokens"))).alias("i"))
             # Non-negative hash: mod = pmod; an empty word list gives NULL
             # (no token rows) instead of a division by zero.
             .withColumn("idx", F.try_mod(R.hash48(F.col("checkout_id"), F.col("i")), n)))
    return draws.join(words, "idx").select("checkout_id", "i", "word")
