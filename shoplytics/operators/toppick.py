"""Top-pick bandit: tallies, Thompson draws, experiment epochs and refresh
(F1-F3, A2, A11, A12, J2, J6, J10, T2-T6, T10, W2, W4, U4, U5).

State of the reference service is a per-item (clicks, impressions) tally and
an experiment counter.  Here the tally is an aggregate over the event table
(or over a micro-batch, see ``shoplytics.streaming.toppick``).

An *epoch* is the span between two experiment refreshes: the counter starts
at 1, each impression adds one, and the impression that brings it to the
refresh interval refreshes the experiment and restarts the counter at 1, so
every epoch holds ``REFRESH_INTERVAL - 1`` impressions.  The epoch of any
event is ``floor(impressions strictly before it / (REFRESH_INTERVAL - 1))``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplytics.functions import random as R
from shoplytics.operators import ordering

# Experiment size, refresh interval, Beta prior, page source tag.
NUM_ITEMS = 4
REFRESH_INTERVAL = 10
PRIOR = 1
TOP_PICK_SOURCE = "top_pick"
IMPRESSIONS_PER_EPOCH = REFRESH_INTERVAL - 1


def is_click() -> Column:
    """F1 on mapped shop events: a page view that came from the top-pick link."""
    return (F.col("source") == TOP_PICK_SOURCE) & (F.col("eventType") == "pageView")


def is_impression() -> Column:
    """F2 on mapped shop events."""
    return (F.col("source") == TOP_PICK_SOURCE) & (F.col("eventType") == "impression")


def is_home_view() -> Column:
    """a home-page view, only considered when neither F1 nor F2 holds."""
    return ~F.coalesce(is_click(), F.lit(False)) & ~F.coalesce(is_impression(), F.lit(False)) \
        & (F.col("pageType") == "home")


def event_kind() -> Column:
    """What the experiment does with a mapped event: the first of F1, F2, F3 that holds, else nothing."""
    return (F.when(F.coalesce(is_click(), F.lit(False)), F.lit("click"))
             .when(F.coalesce(is_impression(), F.lit(False)), F.lit("impression"))
             .when(F.coalesce(is_home_view(), F.lit(False)), F.lit("home")).otherwise(F.lit("none")))


def classify(events: DataFrame, click: Column, impression: Column) -> DataFrame:
    """Keep top-pick events only, with ``is_click`` / ``is_imp`` flags.
    The raw predicates filter first, so they reach the scan as pushed
    filters."""
    return (events.filter(click | impression)
                  .withColumn("is_click", F.coalesce(click, F.lit(False)))
                  .withColumn("is_imp", F.coalesce(impression, F.lit(False)))
                  .filter(F.col("is_click") | F.col("is_imp")))


def tallies(flagged: DataFrame, keys: tuple[str, ...] = ("item",)) -> DataFrame:
    """Clicks and impressions per item (one pass, both counters;
    items seen by either counter appear once).  Map-side partial aggregation
    keeps a hot item to one row per input partition before the shuffle."""
    return flagged.groupBy(*keys).agg(
        F.count_if("is_click").alias("clicks"),
        F.count_if("is_imp").alias("impressions"))


def tallies_merged(flagged: DataFrame, keys: tuple[str, ...] = ("item",)) -> DataFrame:
    """The same tally as a full outer merge of the two counters, absent
    side = 0 (cross-check of :func:`tallies`)."""
    c = flagged.filter("is_click").groupBy(*keys).agg(F.count(F.lit(1)).alias("clicks"))
    i = flagged.filter("is_imp").groupBy(*keys).agg(F.count(F.lit(1)).alias("impressions"))
    return (c.join(i, list(keys), "full_outer")
             .select(*keys, F.coalesce("clicks", F.lit(0)).alias("clicks"),
                     F.coalesce("impressions", F.lit(0)).alias("impressions")))


def shapes(clicks: Column, impressions: Column, prior: int = PRIOR) -> tuple[Column, Column]:
    hits = clicks + F.lit(prior)
    misses = F.greatest(impressions - clicks, F.lit(0)) + F.lit(prior)
    return hits, misses


def posterior_mean(df: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Mean of the Beta posterior, the deterministic companion of T2."""
    a, b = shapes(F.col("clicks"), F.col("impressions"), prior)
    return df.withColumn("mean", a / (a + b))


def draw(df: DataFrame, seed: int, key: Column, prior: int = PRIOR) -> DataFrame:
    """Theta ~ Beta(clicks + 1, max(impressions - clicks, 0) + 1),
    drawn reproducibly from (seed, key)."""
    a, b = shapes(F.col("clicks"), F.col("impressions"), prior)
    return df.withColumn("theta", R.beta(F.lit(seed), key, a, b))


def rank_within(df: DataFrame, group: list[str]) -> DataFrame:
    """Rank by theta (highest first, ties by item) inside each group.
    The groups are experiment epochs: each holds the items tallied in one
    epoch, so no single group carries the whole table."""
    w = Window.partitionBy(*group).orderBy(F.desc("theta"), F.asc("item"))
    return df.withColumn("rank", F.row_number().over(w))


def rank_global(df: DataFrame) -> DataFrame:
    """W2 over one tally with no group: two-level global row number, so a
    large item set is never sorted in one task."""
    return ordering.row_number(df.withColumn("__neg_theta", -F.col("theta")),
                               ["__neg_theta", "item"], "rank").drop("__neg_theta")


def winner(draws: DataFrame) -> DataFrame:
    """The item with the highest draw (ties by item); no items -> no row.
    A top-1 ``orderBy().limit(1)`` plans as TakeOrderedAndProject: each task
    keeps its own best row, only those reach the final task."""
    return draws.orderBy(F.desc("theta"), F.asc("item")).limit(1)


def n_top(n: Column) -> Column:
    """How many items survive a refresh: half, rounded down; a single
    item is kept (slicing ``[-0:]`` keeps everything)."""
    return F.when(n == 1, F.lit(1)).otherwise(F.floor(n / 2)).cast("int")


def assign_epochs(flagged: DataFrame, order_cols: list[str], offset: int = 0,
                  epoch_base: int = 0) -> DataFrame:
    """Per event, impressions strictly before it (global event
    order), its epoch, the counter value after it and whether it refreshed.
    ``offset`` impressions of the current experiment happened before these
    events and the current experiment is epoch ``epoch_base`` (both carried
    from earlier micro-batches by the stream)."""
    r = ordering.running_sum(flagged, order_cols, F.col("is_imp").cast("int"),
                             "prior_impressions", inclusive=False)
    r = r.withColumn("prior_impressions", F.col("prior_impressions") + F.lit(offset))
    through = F.col("prior_impressions") + F.col("is_imp").cast("long")
    return (r.withColumn("epoch", F.floor(F.col("prior_impressions") / IMPRESSIONS_PER_EPOCH)
                         + F.lit(epoch_base))
             .withColumn("counter", (through % IMPRESSIONS_PER_EPOCH + 1).cast("int"))
             .withColumn("refresh", F.col("is_imp") & (through % IMPRESSIONS_PER_EPOCH == 0)))


def keep_top(epoch_tallies: DataFrame, seed: int) -> DataFrame:
    """T3 per epoch: draw every tallied item, keep the best ``n_top(n)``."""
    d = draw(epoch_tallies, seed, F.concat_ws(":", F.col("epoch").cast("string"), F.col("item")))
    d = rank_within(d, ["epoch"])
    n = F.count(F.lit(1)).over(Window.partitionBy("epoch"))
    return d.withColumn("n_items", n).filter(F.col("rank") <= n_top(F.col("n_items")))


def catalog_positions(catalog_ids: DataFrame, seed: int) -> DataFrame:
    """The catalog numbered once: (id, pos) with pos in [0, N), in order of
    md5(seed|id), by a two-level global row number."""
    keyed = catalog_ids.select("id", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id"))).alias("h"))
    return (ordering.row_number(keyed, ["h", "id"], "rn")
            .select("id", (F.col("rn") - 1).alias("pos")))


def refresh(kept: DataFrame, positions: DataFrame, seed: int, compat: bool = False) -> DataFrame:
    """The next experiment of each epoch.

    Kept items, then random catalog items not kept, up to ``NUM_ITEMS``.
    Every epoch draws by a permutation of the catalog's positions of its own
    (:func:`~shoplytics.functions.random.permuted`, keyed by seed and epoch):
    its first places are a draw without replacement, items that come together in
    one epoch do not in another, and the lookup is an equi-join on position
    (no cross join).  ``compat`` draws ``2 * n`` candidates as the reference does
    (and may come up short); the default draws ``n + kept`` so the set is never
    short while the catalog is large enough.
    """
    # Catalog size as a scalar subquery: evaluated once, no join.
    n_cat = positions.agg(F.count(F.lit(1))).scalar()
    per_epoch = (kept.groupBy("epoch").agg(F.count(F.lit(1)).alias("kept"))
                 .withColumn("n_random", F.greatest(F.lit(NUM_ITEMS) - F.col("kept"), F.lit(0)))
                 .withColumn("n_cat", n_cat)
                 .withColumn("m", F.least(
                     (F.col("n_random") * 2) if compat else (F.col("n_random") + F.col("kept")),
                     F.col("n_cat"))))
    # An epoch that needs nothing draws nothing.
    slots = (per_epoch.filter("m > 0 AND n_random > 0")
             .select("epoch", "n_random", "n_cat", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
             .withColumn("pos", R.permuted(F.col("j"), F.col("n_cat"), F.lit(seed), F.lit("fill"), F.col("epoch"))))
    cands = slots.join(positions, "pos").select("epoch", "j", "n_random", F.col("id").alias("item"))
    fresh = cands.join(kept.select("epoch", "item"), ["epoch", "item"], "left_anti")
    fill = (fresh.withColumn("k", F.row_number().over(Window.partitionBy("epoch").orderBy("j")))
                 .filter(F.col("k") <= F.col("n_random"))
                 .select("epoch", "item", F.lit("random").alias("role"), F.col("k").alias("slot")))
    top = kept.select("epoch", "item", F.lit("kept").alias("role"), F.col("rank").alias("slot"))
    return (top.unionByName(fill)
               .select((F.col("epoch") + 1).alias("next_epoch"), "item", "role", "slot",
                       F.lit(1).cast("long").alias("clicks"),
                       F.lit(1).cast("long").alias("impressions")))


def home_picks(flagged: DataFrame, views: DataFrame, order_cols: list[str], seed: int) -> DataFrame:
    """ST7 for every home-page view, as of its time: (view columns, epoch, item, theta,
    clicks, impressions), the item null where nothing of the view's epoch is tallied yet.

    A view sees the tallies of the events of its epoch that come before it.  Views and
    events get their epochs from one running count; a view meets the items of its epoch,
    and its line in each item's history gives the running tally there (two-level sums, so
    an epoch or item of any size is spread over tasks).  The draw is keyed by view and
    item, and the best one per view is a partial aggregate."""
    key = order_cols[-1]
    none = F.lit(None).cast("string")
    line = (flagged.filter(F.col("item").isNotNull()).select(*order_cols, "item", "is_click", "is_imp", F.lit(False).alias("is_view"))
            .unionByName(views.select(*order_cols, none.alias("item"), F.lit(False).alias("is_click"),
                                      F.lit(False).alias("is_imp"), F.lit(True).alias("is_view"))))
    placed = assign_epochs(line, order_cols).select(*order_cols, "epoch", "item", "is_click", "is_imp", "is_view").checkpoint()
    told, asked = placed.filter("NOT is_view"), placed.filter("is_view").drop("item")
    history = told.unionByName(asked.join(told.select("epoch", "item").distinct(), "epoch"))
    staged = ordering.stage(history, ["epoch", "item"], order_cols)
    for flag, out in (("is_click", "clicks"), ("is_imp", "impressions")):
        staged = ordering.staged_running_sum(staged, ["epoch", "item"], order_cols, F.col(flag).cast("int"), out)
    seen = ordering.unstage(staged).filter("is_view AND clicks + impressions > 0")
    drawn = draw(seen, seed, F.concat_ws(":", F.col(key).cast("string"), F.col("item")))
    best = drawn.groupBy(key).agg(F.min_by(F.struct("item", "theta", "clicks", "impressions"), F.struct(-F.col("theta"), "item")).alias("pick"))
    return asked.join(best, key, "left").select(*order_cols, "epoch", "pick.*")
