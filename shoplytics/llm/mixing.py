"""Mixing sources to target weights, with Spark expressions only.

Targets.  Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ...
and share the words of the whole corpus; a target stops at ``max_repeat`` times
its source's size, and the excess is shared again by weight.  In closed form:
target = min(cap, level * weight), where the level is found on the sources
sorted by cap / weight with running sums.

Schedule.  Every source gets round(target / block_words) slots, one at least,
out of S slots in all.  Position i of the schedule takes the van der Corput
point of i on a grid of the next power of two; points map through the cumulative
slot counts to a source, points past S are skipped.  Each grid value comes once,
so every source gets exactly its slots, and any stretch of the schedule holds
the sources near their weights.  The j-th slot of a source takes the j-th of the
equal-word blocks into which its shuffled words (documents in md5 order, started
again at the end) are cut, so a source gives floor(target) words in all.

No step needs the rows of a source together: running sums go by (source, hash
bucket) with one small table of bucket totals, so a source may hold any share.
The per-source table (one row per source) is the only one that is ordered whole.

Defined cases: null text has size 0 and takes 0; a null source is a source of
its own; a null doc_id takes part like any other (its place in the shuffle is its row's); rows that repeat
a doc_id share one place in the shuffle and count each; long texts count whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplytics.llm.common import kept, partitions, pick, plain, row_hash, word_count

BLOCK_WORDS = 4096
MAX_REPEAT = 3
SEED = "mix"


def sizes(docs: DataFrame, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per document: row (a number), doc_id, source, size, order key ``h`` (md5), and ``keep``."""
    d = pick(docs, "doc_id", "text", "source", *keep).withColumn("row", F.monotonically_increasing_id())
    # Rows without an id have places of their own, like others.
    place = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    key = F.md5(F.concat(F.lit(seed), place).cast("binary"))
    return d.select("row", "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("h"), *keep)


def targets(sized: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source: source, sid (0 from the first in code point order), source_size, target."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = by.withColumn("sid", F.row_number().over(order) - 1)
    s = (s.withColumn("weight", (F.col("sid") % 3 + 1).cast("double"))
         .withColumn("cap", (F.col("source_size") * max_repeat).cast("double")))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "total": F.sum("source_size").over(all_).cast("double"),
        "weights": F.sum("weight").over(all_),
        "cap_below": F.coalesce(F.sum("cap").over(up), F.lit(0.0)),
        "weight_below": F.coalesce(F.sum("weight").over(up), F.lit(0.0)),
    })
    # The level if this source and all above it are not capped; the first whose cap is not below it is right, and the largest.
    s = s.withColumn("level", (F.col("total") - F.col("cap_below")) / (F.col("weights") - F.col("weight_below")))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_))
    return s.select("source", "sid", "source_size",
                    F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def with_slots(by_source: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_slots and first_slot (slots of the sources before it)."""
    n = F.when(F.floor("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") / block_words))).otherwise(0)
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return (by_source.withColumn("n_slots", n.cast("long"))
            .withColumn("first_slot", F.coalesce(F.sum("n_slots").over(before), F.lit(0)).cast("long")))


def reversed_bits(i: Column, bits: int) -> Column:
    """The van der Corput point of i, times 2 ** bits."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long") if bits else i


def schedule(by_source: DataFrame) -> DataFrame:
    """(position, sid, rank): the rank-th slot of the source stands at that position.

    ``by_source`` from :func:`with_slots`; only its total goes to the driver."""
    spark = by_source.sparkSession
    total = by_source.agg(F.sum("n_slots")).first()[0] or 0
    bits = max(0, int(total - 1).bit_length())
    grid = spark.range(0, 1 << bits, 1, partitions(spark))
    points = grid.select(F.col("id").alias("position"), reversed_bits(F.col("id"), bits).alias("point"))
    points = points.filter(F.col("point") < total)
    # A point belongs to the source whose slots cover it.  Points go by stretches of the grid, so the
    # join is on equal keys: each source is listed under every stretch that it reaches into.
    stretch = max(1, (1 << bits) // max(1, 4 * partitions(spark)))
    reach = by_source.filter("n_slots > 0").select(
        "sid", "first_slot", "n_slots",
        F.explode(F.sequence(F.floor(F.col("first_slot") / stretch),
                             F.floor((F.col("first_slot") + F.col("n_slots") - 1) / stretch))).alias("cell"))
    placed = (points.withColumn("cell", F.floor(F.col("point") / stretch)).join(reach, "cell")
              .filter((F.col("point") >= F.col("first_slot"))
                      & (F.col("point") < F.col("first_slot") + F.col("n_slots"))))
    # Rank within the source, by position: counts per (source, stretch of positions) first.
    placed = placed.select("position", "sid", F.floor(F.col("position") / stretch).alias("bucket"), F.lit(1).cast("long").alias("one"))
    ranked = running(placed, "sid", "bucket", ["position"], "one", "rank")
    return ranked.select("position", "sid", "rank")


def running(rows: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, by (bucket, order).

    Two levels: totals per (group, bucket) are summed up first, then rows within a bucket."""
    totals = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    above = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"),
                            F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_off"))
    within = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    r = r.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & F.col(bucket).eqNullSafe(F.col("_b")))
    return r.withColumn(out, F.col("_off") + F.col("_in")).drop("_g", "_b", "_off", "_in")


def blocks(placed: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(doc row, block, lo, words): which words of which document each block of its source holds.

    ``placed`` has row columns, sid, start (words of the source before the document), size,
    source_size, target and n_slots.  A source's line of words is read up to ``max_repeat`` times
    and cut at floor(target); block j holds the words from j to j + 1 times the block length."""
    end = F.floor("target")
    length = F.col("target") / F.col("n_slots")
    copies = placed.filter("n_slots > 0 and size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    lo = F.col("copy") * F.col("source_size") + F.col("start")
    cut = (copies.withColumn("lo", lo).withColumn("hi", F.least(F.col("lo") + F.col("size"), end))
           .filter("lo < hi").withColumn("length", length))
    # One block more on either side: the cuts below decide, not the rounding of a division.
    at = cut.withColumn("block", F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor(F.col("lo") / F.col("length")) - 1),
        F.least(F.floor((F.col("hi") - 1) / F.col("length")) + 1, F.col("n_slots") - 1))))
    first = F.greatest(F.col("lo"), F.ceil(F.col("block") * F.col("length")))
    last = F.when(F.col("block") == F.col("n_slots") - 1, F.col("hi")).otherwise(
        F.least(F.col("hi"), F.ceil((F.col("block") + 1) * F.col("length"))))
    return at.withColumn("words", last - first).filter("words > 0").select("row", "sid", "block", first.alias("lo"), "words")


def _dealt(docs: DataFrame, block_words: int, max_repeat: int, seed: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, slots): a row per row of ``docs``; and position, sid, block, row, lo, words: which words
    stand in the slot at which position (``lo``: their place in the source's line of words)."""
    spark = docs.sparkSession
    sized = kept(sizes(docs, seed, keep))
    per = kept(with_slots(targets(sized, max_repeat), block_words))
    rows = sized.join(per, sized["source"].eqNullSafe(per["source"])).drop(per["source"])
    buckets = max(16, 4 * partitions(spark))
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 6), 16, 10).cast("long") * buckets / (1 << 24)))
    rows = kept(running(rows, "sid", "bucket", ["h", "row"], "size", "start"))
    return rows, blocks(rows, max_repeat).join(schedule(per).withColumnRenamed("rank", "block"), ["sid", "block"])


def interleaved(docs: DataFrame, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mix in order: position (of the slot), sid, block, part (within the slot), doc_id,
    word_start, words: which words of which document stand there."""
    rows, slots = _dealt(docs, block_words, max_repeat, seed)
    at = slots.join(rows.select("row", "doc_id", "start", "size", "source_size"), "row")
    inside = Window.partitionBy("position").orderBy("lo")  # the words of one block
    return at.select("position", "sid", "block", (F.row_number().over(inside) - 1).alias("part"), "doc_id",
                     (F.col("lo") % F.col("source_size") - F.col("start")).cast("long").alias("word_start"), "words")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of ``docs``; taken is
    the sum of its words in :func:`interleaved`."""
    rows, slots = _dealt(docs, block_words, max_repeat, seed)
    taken = slots.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: taken / size, to the nearest
    whole copy (at most one document of a source is cut by the end of its target).
    Rows without words have no place in a mix by words and stay once.

    Decided row by row, whatever the ids: a row is told by 128 bits of all its values, and the
    copies of rows that are equal in all of them are added up and shared out among them."""
    inner, names = plain(docs, "doc_id", "text", "source")
    keyed = inner.select("*", row_hash(inner).alias("_k1"), row_hash(inner, F.lit(1)).alias("_k2"))
    named = keyed.select(*[F.col(c).alias(n) for c, n in zip(names, ("doc_id", "text", "source"))], "_k1", "_k2")
    rows, slots = _dealt(named, block_words, max_repeat, seed, ("_k1", "_k2"))
    rows = rows.join(slots.groupBy("row").agg(F.sum("words").alias("taken")), "row", "left")
    copies = F.when(F.col("size") > 0, F.floor(F.coalesce("taken", F.lit(0)) / F.col("size") + 0.5)).otherwise(1)
    part = kept(rows.groupBy("_k1", "_k2").agg(F.sum(copies).cast("int").alias("_all"), F.count("*").cast("int").alias("_rows")))

    def times(met: DataFrame, n: str) -> DataFrame:
        at = met.withColumn("_n", F.expr(n).cast("int")).filter("_n > 0").withColumn("_copy", F.explode(F.expr("array_repeat(1, _n)")))
        return at.select(*inner.columns)

    out = times(keyed.join(part, ["_k1", "_k2"]), "_all div _rows")
    odd = part.filter("_all % _rows > 0")  # equal rows whose copies don't share out evenly: the rest goes to one of them
    if not odd.isEmpty():
        out = out.unionByName(times(keyed.join(odd, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]), "_all % _rows"))
    return out.toDF(*docs.columns)
