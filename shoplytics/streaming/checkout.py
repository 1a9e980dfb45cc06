"""The checkout state machine as a stream (ST9, C11, C15).

State per shopper: the basket (item -> price band), the in-flight checkout
(id, step, e-mail, token count, basket snapshot) and counters of completed
checkouts, rejected requests and wrong responses.  Events are applied in event
order (``ts``, ``event_id``):

* basket add: rejected when the item has no catalog document, else set add;
* basket remove: rejected when the item is not in the basket;
* checkout e-mail: open the checkout (create it when absent; when the basket
  changed since it was created, start over - stored by default, returned
  but not stored under ``compat``), then post the e-mail (step 1), rejected
  when the basket changed;
* completion: open, post the token responses (rejected when the basket changed; a wrong
  response sets the checkout back to step 1, right ones make it a record), open again and
  finish: the checkout and the basket are removed.

Each micro-batch is one sorted pass: its events and the shoppers' states before them are
dealt by shopper and sorted by (shopper, time), and a task goes through them chunk by chunk with
one shopper's machine in memory - its size is that of a basket, whatever share of the events
the shopper has.  A batch writes its states (one narrow row per shopper) and its records to a
folder of its own, from which the next batch takes the states; a replayed batch overwrites the
same folder with the same rows.  So any split of ordered events into batches gives the same.

Tokens are the words at ``hash(checkout id, i) mod n`` of the word list (T8), so the machine
needs no list: a response is looked up (word -> index, an equi-join) before the pass, and
records get their words after it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplytics.functions.random import hash48_py
from shoplytics.functions.times import epoch_millis
from shoplytics.plans.basket import catalog_priced
from shoplytics.sources import bindings
from shoplytics.streaming import runner
from shoplytics.streaming.traffic import event_table_stream

ADD, REMOVE, EMAIL, DONE = "add", "remove", "email", "done"
STATE, RECORD = "state", "record"

_EVENT = "kind string, shopper long, ts_ms long, event_id long, item string, price int, email string, responses array<long>"
_STATE = ("has_basket boolean, basket array<struct<item:string,price:int>>, co_id string, co_step int, co_email string, "
          "co_tokens int, co_snapshot string, completed int, last_completed string, rejected int, wrong int")
_ROW = f"kind string, shopper long, ts_ms long, {_STATE}"


class _Shopper:
    """One shopper's machine."""

    def __init__(self, shopper: int | None, state: dict | None, compat: bool, n_words: int):
        import hashlib
        self.shopper, self.compat, self.n_words = shopper, compat, n_words
        self.hex = hashlib.md5(str(shopper).encode()).hexdigest()
        s = state or {}
        self.basket: dict[str, int] | None = {e["item"]: e["price"] for e in s["basket"]} if s.get("has_basket") else None
        self.co = None
        if s.get("co_id") is not None:
            self.co = {"id": s["co_id"], "step": s["co_step"], "email": s["co_email"], "tokens": s["co_tokens"], "snap": s["co_snapshot"]}
        self.last_completed = s.get("last_completed")
        self.completed, self.rejected, self.wrong = (s.get(c) or 0 for c in ("completed", "rejected", "wrong"))

    def snap(self) -> str | None:
        return None if self.basket is None else "|".join(sorted(self.basket))

    def open(self, ts_ms: int) -> None:
        if self.co is None or (self.co["snap"] != self.snap() and not self.compat):
            self.co = {"id": f"{self.hex}{ts_ms}", "step": 0, "email": None,
                       "tokens": sum((self.basket or {}).values()), "snap": self.snap()}

    def unchanged(self) -> bool:
        """Whether the checkout's basket is the shopper's; a request is rejected if not."""
        same = self.co is not None and self.co["snap"] == self.snap()
        self.rejected += not same
        return same

    def right(self, responses: list[int] | None) -> bool:
        """C11 on word indices: as many as tokens and all right, or (``compat``) all that are given;
        without a list, responses are taken as right."""
        if responses is None:
            return True
        if len(responses) > self.co["tokens"] or (len(responses) < self.co["tokens"] and not self.compat):
            return False
        return all(r == hash48_py(self.co["id"], i) % self.n_words for i, r in enumerate(responses, 1))

    def apply(self, e: dict) -> dict | None:
        """The completed checkout, if the event completes one."""
        kind, item = e["kind"], e["item"]
        if kind == ADD:
            if e["price"] is None:
                self.rejected += 1
            else:
                self.basket = {} if self.basket is None else self.basket
                self.basket[item] = e["price"]
        elif kind == REMOVE:
            if self.basket is not None and item in self.basket:
                del self.basket[item]
            else:
                self.rejected += 1
        elif kind == EMAIL:
            self.open(e["ts_ms"])
            if self.unchanged():
                self.co.update(step=1, email=e["email"])
        elif kind == DONE:
            self.open(e["ts_ms"])
            if self.unchanged():
                if not self.right(e["responses"]):
                    self.co["step"] = 1
                    self.wrong += 1
                    return None
                self.co["step"] = 2
                self.completed += 1
                self.last_completed = self.co["id"]
                record = self.row(RECORD, e["ts_ms"])
                self.co = self.basket = None
                return record
        return None

    def row(self, kind: str, ts_ms: int | None = None) -> dict:
        co = self.co or {}
        return {"kind": kind, "shopper": self.shopper, "ts_ms": ts_ms, "has_basket": self.basket is not None,
                "basket": [{"item": i, "price": p} for i, p in sorted((self.basket or {}).items())],
                "co_id": co.get("id"), "co_step": co.get("step"), "co_email": co.get("email"), "co_tokens": co.get("tokens"),
                "co_snapshot": co.get("snap"), "completed": self.completed, "last_completed": self.last_completed,
                "rejected": self.rejected, "wrong": self.wrong}


def _walk(compat: bool, n_words: int):
    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa
        schema = pa.schema([("kind", pa.string()), ("shopper", pa.int64()), ("ts_ms", pa.int64()), ("has_basket", pa.bool_()),
                            ("basket", pa.list_(pa.struct([("item", pa.string()), ("price", pa.int32())]))),
                            ("co_id", pa.string()), ("co_step", pa.int32()), ("co_email", pa.string()), ("co_tokens", pa.int32()),
                            ("co_snapshot", pa.string()), ("completed", pa.int32()), ("last_completed", pa.string()),
                            ("rejected", pa.int32()), ("wrong", pa.int32())])
        now = None
        for b in batches:
            out = []
            for e in b.to_pylist():
                if now is None or now.shopper != e["shopper"]:
                    if now is not None:
                        out.append(now.row(STATE))
                    now = _Shopper(e["shopper"], e if e["kind"] == STATE else None, compat, n_words)
                if e["kind"] != STATE and (record := now.apply(e)):
                    out.append(record)
            yield pa.RecordBatch.from_pylist(out, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row(STATE)], schema)
    return walk


def checkout_events(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Shop events of the checkout machine, each basket event with the
    item's price band (NULL when the item has no catalog document); ``email`` and
    ``responses`` (words) come along where the events have them."""
    kind = (F.when(F.col("event_type") == bindings.BASKET_ADD, F.lit(ADD))
             .when(F.col("event_type") == bindings.BASKET_REMOVE, F.lit(REMOVE))
             .when(F.col("event_type") == bindings.CHECKOUT_EMAIL, F.lit(EMAIL))
             .when(F.col("event_type") == bindings.CHECKOUT_DONE, F.lit(DONE)))
    ev = (events.withColumn("kind", kind)
                .filter(F.col("kind").isNotNull()
                        & (F.col("item").isNotNull() | F.col("kind").isin(EMAIL, DONE))))
    priced = ev.join(prices.select(F.col("id").alias("item"), "price"), "item", "left")
    return priced.select("kind", "shopper", epoch_millis("ts").alias("ts_ms"), "event_id", "item", "price",
                         *[c for c in ("email", "responses") if c in events.columns])


def with_word_indices(events: DataFrame, words: DataFrame) -> DataFrame:
    """``responses`` as indices of the word table (idx, word), -1 for a word not in it."""
    said = events.select("event_id", F.posexplode("responses").alias("pos", "word"))
    met = said.join(words, "word", "left").groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("idx", F.lit(-1)).alias("idx")))).alias("met"))
    known = F.coalesce(F.transform("met", lambda x: x["idx"]), F.array().cast("array<long>"))
    return (events.withColumnRenamed("responses", "said").join(met, "event_id", "left")
            .withColumn("responses", F.when(F.col("said").isNotNull(), known)).drop("said", "met"))


class CheckoutStream:
    """``foreachBatch`` handler: one sorted pass per micro-batch (see above)."""

    def __init__(self, folder: str, compat: bool = False, words: DataFrame | None = None):
        self.folder, self.compat, self.words = folder, compat, words
        self.n_words = max(1, words.count()) if words is not None else 1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        events = batch
        if "responses" in batch.columns and self.words is not None:
            events = with_word_indices(batch, self.words)
        for name, type_ in (c.strip().split(" ", 1) for c in _EVENT.split(", ")):
            events = events.withColumn(name, (F.col(name) if name in events.columns else F.lit(None)).cast(type_))
        if batch_id:  # a missing folder is an error, not a new start
            before = batch.sparkSession.read.schema(_ROW).parquet(f"{self.folder}/batch={batch_id - 1}")
            events = events.unionByName(before.filter(F.col("kind") == STATE), allowMissingColumns=True)
        else:
            for name, type_ in (c.split(" ", 1) for c in _STATE.split(", ")):
                events = events.withColumn(name, F.lit(None).cast(type_))
        order = ["shopper", F.col("kind") != STATE, "ts_ms", "event_id"]
        rows = events.repartition("shopper").sortWithinPartitions(*order)
        rows.mapInArrow(_walk(self.compat, self.n_words), _ROW).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")


def run(events: DataFrame, root: str, compat: bool = False, words: DataFrame | None = None) -> DataFrame:
    """Everything available, as rows of :data:`_ROW` with their ``batch``: every batch's records and states."""
    spark, folder = events.sparkSession, f"{root}/checkouts"
    q = (events.writeStream.foreachBatch(CheckoutStream(folder, compat, words))
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    if not runner.path_exists(spark, folder):
        if any(p.numInputRows for p in q.recentProgress):
            raise RuntimeError(f"the stream read rows, but no batch wrote to {folder}")
        return spark.createDataFrame([], f"{_ROW}, batch int")
    return spark.read.option("basePath", folder).schema(f"{_ROW}, batch int").parquet(folder)


def states(rows: DataFrame) -> DataFrame:
    """The shoppers after the last batch."""
    last = rows.agg(F.max("batch")).first()[0]
    now = rows.filter((F.col("kind") == STATE) & (F.col("batch") == F.lit(last)))
    items = F.when(F.col("has_basket"), F.array_join(F.transform("basket", lambda x: x["item"]), "|"))
    return now.select("shopper", items.alias("items"), F.col("co_id").alias("checkout_id"), F.col("co_step").alias("step"),
                      F.col("co_tokens").alias("n_tokens"), "completed", "last_completed", "rejected", "wrong")


def records(rows: DataFrame) -> DataFrame:
    """Every completed checkout, once: id, shopper, time, e-mail, basket and number of tokens."""
    done = rows.filter(F.col("kind") == RECORD)
    return done.select(F.col("co_id").alias("checkout_id"), "shopper", "ts_ms", F.col("co_email").alias("email"),
                       F.col("co_snapshot").alias("items"), F.col("co_tokens").alias("n_tokens"))


def _source(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    src = event_table_stream(spark, sf_dir)
    ev = src.select("event_id", "ts", F.col("user_id").alias("shopper"), "event_type",
                    bindings.product_id().alias("item"), *more)
    # Stream-static join with the catalog's price bands.
    return checkout_events(ev, catalog_priced(spark, sf_dir))


def checkout_state_stream(spark: SparkSession, sf_dir: str, compat: bool = False) -> DataFrame:
    rows = run(_source(spark, sf_dir), runner.scratch(spark, "checkout-state"), compat)
    return states(rows).drop("wrong")


def checkout_records(spark: SparkSession, sf_dir: str, words: DataFrame, compat: bool = True) -> DataFrame:
    """All rows of the machine over the event table, responses checked (reference rule: those that are given)."""
    events = _source(spark, sf_dir, bindings.checkout_email().alias("email"), bindings.token_responses().alias("responses"))
    return run(events, runner.scratch(spark, "checkout-records"), compat, words)
