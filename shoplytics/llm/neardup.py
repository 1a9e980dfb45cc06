"""MinHash near-duplicates with an LSH forest of sorted signature orders.

1. Sketch: the set of hashed word shingles of each whole text, and its MinHash
   signature of 80 values.  Texts with one shingle set form a class with a number of its
   own, represented by the row of its smallest doc_id; only representatives go on.
2. Forest: tree t orders the representatives by the signature rotated to start at
   its 4t-th value.  The orders are range-partitioned and sorted by Spark, so a dense
   region is split over tasks.  Neighbours in an order that share the first four
   values (the longest common prefixes there are) are candidates.
3. Confirm: a candidate whose signatures agree in enough places is confirmed on the
   full shingle sets; confirmed pairs are links.
4. The rest: in regions of a tree with three or more members that are still in
   several components, everything outside the largest component is compared with all
   members, on the full shingle sets, by matrix products inside a task that sees a block
   of about ``BLOCK`` by ``BLOCK`` sets; only links come out.  A region of any size is
   compared whole: one of more than ``BLOCK`` members in several blocks.

A pair at the similarity 0.8 shares four values in one of the 20 trees with
probability 1 - (1 - 0.8 ** 4) ** 20 = 0.99997, and more above it, whatever the size of
the region.  Copies are never expanded into pairs: rows are documents with their
component, links are between classes.

Defined cases: null text or one without words has no shingles and no links.  A text of
fewer words than a shingle has one, its whole sequence.  Rows are linked by their texts, so a
null doc_id takes part like any other: a group is named by its smallest doc_id that is not
null, and has a null component_id if there is none, in which case one row of it is kept.  To
``near_duplicates``, rows of one doc_id with several texts are one document, linked as any of its
texts is; ``deduplicated`` decides by row, and drops none but those whose own text is in the
group of the row that stays (smallest doc_id, nulls last; of rows equal in id and text, one).
An empty table gives no rows; extra columns are ignored by ``near_duplicates`` and kept by
``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplytics.llm.common import WORD, kept, partitions, pick, plain, row_hash
from shoplytics.llm.components import components

SHINGLE = 5
PERCENT = 80
TREES, BASE = 20, 4
VALUES = TREES * BASE
#: Members of a region that are compared in one block.
BLOCK = 2048
_WIDTH = 4096
#: Four standard deviations of the signature's estimate below the threshold.
AGREE = int(VALUES * (0.8 - 4 * (0.8 * 0.2 / VALUES) ** 0.5))
#: Keys of texts that may be broadcast (32 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 500_000

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = _mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[:VALUES], _SEEDS[VALUES:] | _U(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, words split at
    space and tab to return (what ``bytes.lower`` and ``bytes.split`` do)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        h = _mixed(h * _U(0x9E3779B97F4A7C15) + w[j:len(w) - n + 1 + j])
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(hashes), 2048):
        part = ((hashes[i:i + 2048, None] ^ _XOR) * _MUL) >> _U(32)
        out = np.minimum(out, part.min(0).astype(np.uint32))
    return out


def _text_keys(text: str) -> tuple[Column, Column]:
    """128 bits that tell a text from others."""
    return F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, t1, t2 (of the text), n_shingles, set_key (digest of the shingle set), sig; null key and sig without shingles."""

    @F.pandas_udf("n_shingles long, set_key string, sig binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = shingles(t, size)
            rows.append((len(h), xxhash.xxh128_hexdigest(h.tobytes()), signature(h).tobytes()) if len(h) else (0, None, None))
        return pd.DataFrame(rows, columns=["n_shingles", "set_key", "sig"])

    rows = pick(docs, "doc_id", "text").select("doc_id", *_text_keys("text"), sketch("text").alias("_s"))
    return rows.select("doc_id", "t1", "t2", "_s.*")


def _orders(reps: DataFrame, *more: str) -> DataFrame:
    """One row per representative and tree: key (hash of the first four values and the
    tree), rest (the next four), and the columns of ``more``."""
    width = 4 * BASE
    ring = F.concat("sig", "sig")
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    at = reps.select("rep", *more, ring.alias("ring"), trees.alias("tree"))
    return at.select("rep", *more, F.xxhash64(F.substr("ring", F.col("tree") * width + 1, F.lit(width)), F.col("tree")).alias("key"),
                     F.substr("ring", (F.col("tree") + 1) * width + 1, F.lit(width)).alias("rest"))


def _neighbours(reps: DataFrame) -> DataFrame:
    """Candidates (a, b): neighbours in a tree's order with one key."""

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for p in parts:
            if not len(p):
                continue
            if last is not None:
                p = pd.concat([last, p], ignore_index=True)
            else:
                first = p.iloc[:1]
            key, rep = p["key"].to_numpy(), p["rep"].to_numpy()
            same = np.flatnonzero((key[1:] == key[:-1]) & (rep[1:] != rep[:-1]))
            yield pd.DataFrame({"a": rep[same], "b": rep[same + 1], "key": None, "rest": None})
            last = p.iloc[-1:]
        if first is not None:  # the ends of the partition, to be paired with the next one's
            ends = pd.concat([first, last], ignore_index=True)
            yield pd.DataFrame({"a": ends["rep"], "b": None, "key": ends["key"], "rest": ends["rest"]})

    spark = reps.sparkSession
    order = _orders(reps)
    dealt = order.repartitionByRange(max(partitions(spark), TREES), "key", "rest", "rep").sortWithinPartitions("key", "rest", "rep")
    found = kept(dealt.select("key", "rest", "rep").mapInPandas(walk, "a long, b long, key long, rest binary"))
    seam = Window.orderBy("key", "rest", "a")  # two rows per partition
    ends = found.filter("b IS NULL").select("a", F.lead("a").over(seam).alias("b"), "key", F.lead("key").over(seam).alias("next"))
    return _pairs(found.filter("b IS NOT NULL").select("a", "b").unionByName(ends.filter("key = next").select("a", "b")))


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _promising(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs whose sizes allow the similarity and whose signatures agree in enough places."""

    @F.pandas_udf("boolean")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        u = np.frombuffer(b"".join(x), dtype=np.uint32).reshape(len(x), VALUES)
        v = np.frombuffer(b"".join(y), dtype=np.uint32).reshape(len(y), VALUES)
        return pd.Series((u == v).sum(1) >= AGREE)

    a = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    b = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    near = pairs.join(a, "a").join(b, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    return near.filter(agree("sa", "sb")).select("a", "b").distinct()


def _sets(docs: DataFrame, ids: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """rep, set: the shingle hashes, as bytes, of the classes in ``ids``, from their representatives' texts."""

    @F.pandas_udf("binary")
    def full(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, size).tobytes() for t in texts])

    first = reps.select("rep", F.col("first.doc_id").alias("id"), F.col("first.t1").alias("k1"), F.col("first.t2").alias("k2"))
    ids = kept(first.join(ids.distinct(), "rep", "left_semi"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids
    texts = pick(docs, "doc_id", "text").select("doc_id", "text", *_text_keys("text"))
    met = texts.join(ids, (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return met.select("rep", full("text").alias("set")).distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """The pairs with 100 * shared >= PERCENT * union, on the full shingle sets."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            u, v = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            out.append(both > 0 and 100 * both >= PERCENT * (len(u) + len(v) - both))
        return pd.Series(out, dtype=bool)

    sets = _sets(docs, pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))), reps, size)
    a = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    return kept(pairs.join(a, "a").join(b, "b").filter(linked("sa", "sb")).select("a", "b").distinct())


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``left`` shares with each of ``right``, by products of 0/1 matrices."""
    sets = left + right
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Only hashes of two sets or more matter; number them, and go through them in columns of bounded width.
    number = np.cumsum(counts > 1) - 1
    of, place = of[counts[place] > 1], number[place[counts[place] > 1]]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    for start in range(0, int((counts > 1).sum()), _WIDTH):
        lo, hi = np.searchsorted(place, (start, start + _WIDTH))
        m = np.zeros((len(sets), _WIDTH), dtype=np.float32)
        m[of[lo:hi], place[lo:hi] - start] = 1
        out += (m[:len(left)] @ m[len(left):].T).astype(np.int64)
    return out


def _region_links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links across components among the rows (side, rep, comp, set) of one region or block
    of it; of a left row's links into one component, one."""
    left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] != 0]
    if not left or not right:
        return
    x, y = ([np.frombuffer(r[3], dtype=np.uint64) for r in side] for side in (left, right))
    both = shared_counts(x, y)
    union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - both
    comp = np.array([r[2] for r in right])
    linked = (100 * both >= PERCENT * union) & (np.array([r[2] for r in left])[:, None] != comp[None, :])
    for i in np.flatnonzero(linked.any(1)):
        at = np.flatnonzero(linked[i])
        for j in at[np.unique(comp[at], return_index=True)[1]]:
            yield left[i][1], right[j][1]


def _across(reps: DataFrame, comps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Links of step 4: between different components within one region."""
    r = reps.select("rep", "sig").join(comps, F.col("rep") == F.col("node"), "left")
    order = _orders(r.select("rep", "sig", F.coalesce("component", "rep").alias("comp")), "comp")

    seen = order.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    names = ["key", "rep", "comp"]
    region = kept(order.select(names).join(seen.filter("n > 2 AND lo < hi").select("key"), "key"))

    # Each region's largest component, and its number of blocks outside that one and in all; of regions
    # with the same members, one.
    parts = region.groupBy("key", "comp").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("x"))
    per = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.expr("bit_xor(x)").alias("x"))
    per = per.groupBy("n", "x").agg(F.min_by(F.struct("key", "top"), "key").alias("one")).select(
        "one.key", F.col("one.top.comp").alias("main"), F.ceil((F.col("n") - F.col("one.top.n")) / BLOCK).cast("int").alias("lefts"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("rights"))
    region = kept(region.join(per, "key"))

    # Everything outside the largest component (left) against everything (right), in blocks.
    def own(blocks: str) -> Column:
        return F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    outside = F.col("comp") != F.col("main")
    whole = region.filter("rights = 1").select(
        *names, F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(outside, 2).otherwise(1).alias("side"))
    cut = region.filter("rights > 1")
    rows = whole.unionByName(cut.filter(outside).select(*names, own("lefts").alias("i"), every("rights").alias("j"), F.lit(0).alias("side"))) \
        .unionByName(cut.select(*names, every("lefts").alias("i"), own("rights").alias("j"), F.lit(1).alias("side")))
    rows = rows.join(_sets(docs, region.select("rep"), reps, size), "rep")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Region by region: their rows are together, in order."""
        now, held = None, []
        for p in parts:
            found = []
            for key, row in zip(zip(p["key"], p["i"], p["j"]), zip(p["side"], p["rep"], p["comp"], p["set"])):
                if key != now:
                    found += _region_links(held)
                    now, held = key, []
                held.append(row)
            yield pd.DataFrame(found, columns=["a", "b"])
        yield pd.DataFrame(list(_region_links(held)), columns=["a", "b"])

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return _pairs(dealt.select("key", "i", "j", "side", "rep", "comp", "set").mapInPandas(walk, "a long, b long"))


def _links(docs: DataFrame, size: int, reps: DataFrame, known: DataFrame) -> DataFrame:
    """The confirmed links (a, b) between classes; ``known``: links that hold anyway."""
    near = kept(_promising(_neighbours(reps), reps))
    one = kept(_confirmed(near, docs, reps, size).unionByName(known))
    return one.unionByName(kept(_across(reps, components(one), docs, size)))


def _classes(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): a narrow row per row of ``docs``; set_key, sig, n_shingles, rep (a number) and
    ``first``, the representative row, of each class."""
    rows = kept(sketches(docs, size).withColumn("row", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t1", "t2", "row"))
    by_set = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(
        first.alias("first"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    return rows.select("row", "doc_id", "n_shingles", "set_key"), kept(by_set.withColumn("rep", F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    rows, reps = _classes(docs, size)
    rows = rows.join(reps.select("set_key", "rep", "first"), "set_key", "left")
    # A doc_id with several texts joins their classes, and its rows without shingles go with them.
    known = rows.filter("rep IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "rep", "first")
    ends = known.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.min_by("first", "rep").alias("first"))
    several = known.drop("first").join(ends.filter("a < z").select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()
    bare = rows.filter("set_key IS NULL").drop("rep", "first").join(ends.select("doc_id", F.col("a").alias("rep"), "first"), "doc_id", "left")
    rows = rows.filter("set_key IS NOT NULL").unionByName(bare)

    comps = kept(components(_links(docs, size, reps, several)))
    tops = comps.join(reps.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("top"))
    out = rows.join(comps.join(tops, "component").select("node", "top"), F.col("rep") == F.col("node"), "left")
    out = out.withColumn("top", F.coalesce("top", "first"))
    component = F.coalesce("top.doc_id", "doc_id")
    stays = (F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == component).when(F.col("top").isNull(), F.lit(True))
             .otherwise(F.col("top.nameless") & (F.col("row") == F.col("top.row"))))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), stays.alias("kept"))


def deduplicated(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group; rows without shingles all stay."""
    _, reps = _classes(docs, size)
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    comps = kept(components(_links(docs, size, reps, none)))
    groups = reps.select("rep", "first").join(comps, F.col("rep") == F.col("node"), "left")
    tops = groups.groupBy(F.coalesce("component", "rep").alias("group")).agg(F.min("first").alias("top"))

    inner, (doc_id, text) = plain(docs, "doc_id", "text")
    keys = ["_t1", "_t2", "_null", "_id"]

    def keyed(id_: str, *t: Column) -> list[Column]:
        return [t[0].alias("_t1"), t[1].alias("_t2"), F.col(id_).isNull().alias("_null"), F.coalesce(id_, F.lit(0)).alias("_id")]

    chosen = tops.select(*keyed("top.doc_id", F.col("top.t1"), F.col("top.t2")))
    worded = F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    # The rows that stay grow with the input: a shuffle join, whose partitioning also serves to take one of equal rows.
    stay = inner.filter(worded).select("*", *keyed(doc_id, *_text_keys(text))).join(chosen, keys, "left_semi")
    one = stay.groupBy(*keys).agg(F.min_by(F.struct(*inner.columns), row_hash(inner)).alias("r")).select("r.*")
    return one.unionByName(inner.filter(~worded)).toDF(*docs.columns)
