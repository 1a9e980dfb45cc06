"""Top-pick experiment as a stream (ST6, ST7, ST11).

Each micro-batch (``foreachBatch``):

1. reads the experiment state left by the previous batch from the shared
   state folder: the per-item (clicks, impressions) tally of the current
   experiment, its epoch number and the impressions it has seen;
2. in parallel on the executors: flags top-pick clicks / impressions,
   assigns every event its epoch (two-level running count, carried offset),
   tallies (epoch, item) and looks up the random fill candidates of every
   epoch that ends in this batch (equi-join on a permutation position);
3. chains the refreshes over those small per-epoch aggregates in epoch
   order - the one sequential step, as in the reference's single consumer:
   each experiment's kept items feed the next.  It streams through the
   sorted aggregates (``mapInPandas`` over one ordered partition), holding
   only the current experiment in memory;
4. writes the new state and the experiments started, under the batch id
   (overwrite: a replayed batch gives the same files).

The state folder lives under the cluster's checkpoint folder, so a restarted
query resumes from the last committed batch (ST11); ``refresh_on_start``
refreshes once when the process starts, as the reference consumer does.

A home-page view refreshes only while the experiment has no items (F3).
With a non-empty catalog every refresh yields at least one item (the start
refresh fills from the catalog, later ones keep at least one), so that rule
never fires; only an empty catalog could leave the experiment empty.  The
stream requires a non-empty catalog and does not route home views.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytics.functions import random as R
from shoplytics.operators import toppick as tp

CHAIN_IN = ("epoch long, kord int, j int, item string, clicks long, impressions long")
CHAIN_OUT = ("kind string, epoch long, item string, clicks long, impressions long, "
             "role string, slot int")
CARRY, TALLY, CAND, REFRESH = 0, 1, 2, 3


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def make_chain(seed: int, compat: bool = False):
    """The sequential refresh chain over rows sorted by (epoch, kord, j)."""
    def refresh(state: dict, cands: list, epoch: int):
        items = sorted(state)
        n = len(items)
        draws = sorted(((-R.beta_py(seed, f"{epoch}:{it}", state[it][0] + tp.PRIOR,
                                    max(state[it][1] - state[it][0], 0) + tp.PRIOR), it)
                        for it in items))
        n_keep = 1 if n == 1 else n // 2
        kept = [it for _, it in draws[:n_keep]]
        n_random = max(tp.NUM_ITEMS - len(kept), 0)
        # Candidates drawn: 2n as the reference does (may come up short), or
        # n + kept by default (never short while the catalog is large enough).
        m = 2 * n_random if compat else n_random + len(kept)
        fill = [c for c in cands[:m] if c not in kept][:n_random]
        rows = [("experiment", epoch + 1, it, 1, 1, "kept", k + 1) for k, it in enumerate(kept)]
        rows += [("experiment", epoch + 1, it, 1, 1, "random", k + 1) for k, it in enumerate(fill)]
        return {it: [1, 1] for it in kept + fill}, rows

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, list[int]] = {}
        cands: list[str] = []
        last_epoch = None
        for pdf in batches:
            out = []
            for epoch, kord, item, c, i in zip(pdf["epoch"], pdf["kord"], pdf["item"],
                                               pdf["clicks"], pdf["impressions"]):
                last_epoch = int(epoch)
                if kord == CARRY:
                    state[item] = [int(c), int(i)]
                elif kord == TALLY:
                    s = state.setdefault(item, [0, 0])
                    s[0] += int(c)
                    s[1] += int(i)
                elif kord == CAND:
                    cands.append(item)
                else:
                    state, rows = refresh(state, cands, int(epoch))
                    cands = []
                    out += rows
            if out:
                yield pd.DataFrame(out, columns=["kind", "epoch", "item", "clicks",
                                                 "impressions", "role", "slot"])
        final = [("state", last_epoch, it, c, i, None, None) for it, (c, i) in state.items()]
        yield pd.DataFrame(final, columns=["kind", "epoch", "item", "clicks", "impressions",
                                           "role", "slot"])
    return chain


class TopPickStream:
    """foreachBatch handler holding the experiment state in ``root``."""

    def __init__(self, root: str, catalog_ids: DataFrame, seed: int = 7,
                 compat: bool = False, refresh_on_start: bool = True):
        self.root, self.seed, self.compat = root, seed, compat
        self.catalog_ids = catalog_ids
        self.refresh_on_start = refresh_on_start
        self._started = False
        self._positions = None

    def state_dir(self, batch_id: int) -> str:
        return os.path.join(self.root, "state", f"batch={batch_id}")

    def positions(self) -> DataFrame:
        if self._positions is None:
            # The catalog permutation is built once per process and reused.
            self._positions = tp.catalog_positions(self.catalog_ids, self.seed).cache()
        return self._positions

    def candidates(self, spark: SparkSession, epochs: DataFrame) -> DataFrame:
        """Fill candidates of each ending epoch: consecutive positions of the
        catalog permutation from a start keyed by (seed, epoch)."""
        pos = self.positions()
        n_cat = pos.agg(F.count(F.lit(1))).scalar()
        m = 2 * tp.NUM_ITEMS if self.compat else tp.NUM_ITEMS
        # Non-negative operands: mod = pmod.  An empty catalog has no slots
        # (the filter), and try_mod never divides by zero.
        slots = (epochs.filter(n_cat > 0)
                 .withColumn("start", F.try_mod(R.hash48(F.lit(self.seed), F.lit("fill"),
                                                         F.col("epoch")), n_cat))
                 .withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(m), n_cat) - 1)))
                 .withColumn("pos", F.try_mod(F.col("start") + F.col("j"), n_cat)))
        return slots.join(pos, "pos").select("epoch", F.lit(CAND).alias("kord"), "j",
                                             F.col("id").alias("item"),
                                             F.lit(0).cast("long").alias("clicks"),
                                             F.lit(0).cast("long").alias("impressions"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev = self.state_dir(batch_id - 1)
        if batch_id > 0 and path_exists(spark, prev + "/meta"):
            meta = spark.read.parquet(prev + "/meta").first()
            epoch0, offset = int(meta["epoch"]), int(meta["imp_in_epoch"])
            carry = spark.read.parquet(prev + "/items").select(
                F.lit(epoch0).cast("long").alias("epoch"), F.lit(CARRY).alias("kord"),
                F.lit(0).alias("j"), "item", "clicks", "impressions")
            start_refresh = self.refresh_on_start and not self._started
        else:
            epoch0, offset = -1, 0
            carry = spark.createDataFrame([], CHAIN_IN)
            start_refresh = True
        self._started = True
        markers = []
        if start_refresh:
            markers.append(epoch0)
            epoch0, offset = epoch0 + 1, 0

        flagged = batch.persist()
        ep = tp.assign_epochs(flagged, ["ts", "event_id"], offset=offset, epoch_base=epoch0)
        ep = ep.persist()
        tallies = tp.tallies(ep, ("epoch", "item")).select(
            "epoch", F.lit(TALLY).alias("kord"), F.lit(0).alias("j"), "item",
            "clicks", "impressions")
        ending = ep.filter("refresh").select("epoch")
        if markers:
            ending = ending.unionByName(spark.createDataFrame([(e,) for e in markers], "epoch long"))
        ending = ending.distinct()
        refresh_rows = ending.select("epoch", F.lit(REFRESH).alias("kord"), F.lit(0).alias("j"),
                                     F.lit(None).cast("string").alias("item"),
                                     F.lit(0).cast("long").alias("clicks"),
                                     F.lit(0).cast("long").alias("impressions"))
        rows = (carry.unionByName(tallies).unionByName(self.candidates(spark, ending))
                     .unionByName(refresh_rows))
        out = (rows.repartition(1).sortWithinPartitions("epoch", "kord", "j")
                   .mapInPandas(make_chain(self.seed, self.compat), CHAIN_OUT)).persist()

        n_imp = ep.agg(F.count_if("is_imp")).first()[0]
        total = offset + int(n_imp)
        epoch1 = epoch0 + total // tp.IMPRESSIONS_PER_EPOCH
        imp1 = total % tp.IMPRESSIONS_PER_EPOCH
        d = self.state_dir(batch_id)
        (out.filter("kind = 'state'").select("item", "clicks", "impressions")
            .coalesce(1).write.mode("overwrite").parquet(d + "/items"))
        (out.filter("kind = 'experiment'").select("epoch", "item", "role", "slot")
            .coalesce(1).write.mode("overwrite").parquet(
                os.path.join(self.root, "experiments", f"batch={batch_id}")))
        spark.createDataFrame([(epoch1, imp1)], "epoch long, imp_in_epoch long") \
            .write.mode("overwrite").parquet(d + "/meta")
        out.unpersist()
        ep.unpersist()
        flagged.unpersist()


def run(source: DataFrame, handler: TopPickStream, checkpoint: str):
    """ST6: drive the flagged top-pick stream through the handler."""
    q = (source.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def latest_state(spark: SparkSession, root: str) -> DataFrame:
    """The state written by the newest batch (items and epoch); empty when
    no batch ran."""
    fs, p = _fs(spark, os.path.join(root, "state"))
    ids = [] if not fs.exists(p) else sorted(
        int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p)
        if s.getPath().getName().startswith("batch="))
    if not ids:
        return spark.createDataFrame([], "item string, clicks long, impressions long, epoch long")
    d = os.path.join(root, "state", f"batch={ids[-1]}")
    meta = spark.read.parquet(d + "/meta")
    return spark.read.parquet(d + "/items").withColumn("epoch", meta.select("epoch").scalar())


def serve(state: DataFrame, catalog: DataFrame, seed: int, request: str = "serve") -> DataFrame:
    """ST7 / T2 / J2: the winner for one request - Thompson draw over the
    current state, best item, joined to its catalog document (left join: an
    item without a document still wins, with NULL fields)."""
    d = tp.draw(state, seed, F.concat_ws(":", F.lit(request), F.col("item")))
    w = tp.winner(d).select("item", "theta")
    # The winner's id as a scalar goes to the catalog scan, which leaves one row on either side.
    item = catalog.withColumnRenamed("id", "item")
    return w.join(item.filter(F.col("item") == w.select("item").scalar()), "item", "left")


def flagged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-pick clicks / impressions of the event files as a stream."""
    from shoplytics.sources import bindings
    from shoplytics.streaming.traffic import event_table_stream
    ev = event_table_stream(spark, sf_dir).select(
        "event_id", "ts", F.col("user_id").alias("shopper"), "event_type",
        bindings.product_id().alias("item"))
    return tp.classify(ev, F.col("event_type") == bindings.TOP_PICK_CLICK,
                       F.col("event_type") == bindings.TOP_PICK_IMPRESSION) \
        .select("event_id", "ts", "item", "is_click", "is_imp")
