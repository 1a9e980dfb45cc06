"""Document fingerprints from closed syncmers, with Spark expressions only.

A text is a sequence of tokens: words, cut into pieces of at most 16 characters.
Inner substrings are pairs of tokens, k-mers are K tokens; each has a 64-bit
hash.  A k-mer is a closed syncmer when the smallest hash among its inner pairs
stands at its first or its last place (a tie with the edge counts).  Whether a
k-mer is chosen depends on nothing around it, so the same passage gives the same
anchors wherever it stands, and the anchors keep the order of the text.

The fingerprint is the anchors in text order, eight hex digits each.  Likeness of
two fingerprints: twice the shared distinct anchors over the distinct anchors of
both - for a text of which a part was replaced, about the part that stayed.

The next document by id: documents go to buckets by ranges of doc_id, one shuffle
of the texts; ``lead`` looks within a bucket, and a copy of the first row of the
next bucket stands at the end of each, so no step sees all documents in order.

Defined cases: null text is empty; an empty text has an empty fingerprint, like
(1.0) only another without tokens; a text of fewer than K tokens, or of more without
a closed syncmer, has one anchor, its whole sequence; null doc_ids come first; rows with one doc_id stand in text order;
the single row of a table is its own next document; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplytics.llm.common import partitions, pick

TOKEN = r"[^\x20\x09-\x0D]{1,16}"
#: Tokens of a k-mer; its inner substrings are pairs, so K - 1 of them.
K = 10
FIRST_KEY = -(1 << 63)


def with_anchors(rows: DataFrame, text: str, out: str, whole: bool = True) -> DataFrame:
    """Adds ``out``: array<long>, the hashes of the closed syncmers of ``text`` in order.

    A text of K tokens or more may hold none; ``whole`` gives it the hash of its whole sequence."""
    last = K - 2  # the last inner pair's offset
    rows = rows.withColumn("_h", F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
    rows = rows.withColumns({"_n": F.size("_h"), "_s": F.transform("_h", lambda v, i: F.xxhash64(v, F.get("_h", i + 1)))})

    def inner(i: Column, j: int) -> Column:
        return F.get("_s", i + j)

    def chosen(v: Column, i: Column) -> Column:
        edge = F.least(v, inner(i, last))
        return F.when((i + K <= F.col("_n")) & (edge <= F.least(*[inner(i, j) for j in range(1, last)])),
                      F.xxhash64(v, *[inner(i, j) for j in range(2, K - 1, 2)]))

    anchors = F.filter(F.transform("_s", chosen), lambda a: a.isNotNull())
    rows = rows.withColumn(out, F.when(F.col("_n") >= K, anchors).otherwise(F.array().cast("array<bigint>")))
    bare = (F.size(out) == 0) & (F.col("_n") > 0)
    rows = rows.withColumn(out, F.when(bare if whole else bare & (F.col("_n") < K), F.array(F.xxhash64("_h"))).otherwise(F.col(out)))
    return rows.drop("_h", "_n", "_s")


def fingerprint(anchors: Column) -> Column:
    """Eight hex digits per anchor."""
    return F.array_join(F.transform(anchors, lambda a: F.right(F.hex(a.bitwiseOR(F.lit(FIRST_KEY))), F.lit(8))), "")


def likeness(a: str, b: str) -> Column:
    """0 to 1, from two arrays of distinct anchors."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, anchors array<long>, fingerprint: per row of ``docs``."""
    d = pick(docs, doc_id, text).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return with_anchors(d, "text", "anchors").select("doc_id", "anchors", fingerprint(F.col("anchors")).alias("fingerprint"))


def _ranges(keys: DataFrame, n: int) -> list[int]:
    """At most n - 1 ascending bounds that split ``key`` evenly (from quantiles; bounded by n)."""
    if n < 2:
        return []
    at = ",".join(str(i / n) for i in range(1, n))
    got = keys.agg(F.expr(f"percentile_approx(key, array({at}), {10 * n})").alias("q")).first()[0]
    return sorted(set(got or []))


def _bucket(bounds: list[int]) -> Column:
    """Number of bounds at or below ``key``: first among every m-th bound, then between two of those."""
    if not bounds:
        return F.lit(0)
    m = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i:i + m] for i in range(0, len(bounds), m)]
    array = lambda xs: "array(" + ",".join(f"{x}L" for x in xs) + ")"
    heads = F.expr(array(g[0] for g in groups))
    nested = F.expr("array(" + ",".join(array(g) for g in groups) + ")")
    g = F.size(F.filter(heads, lambda b: b <= F.col("key")))
    within = F.size(F.filter(F.get(nested, g - 1), lambda b: b <= F.col("key")))
    return F.when(g == 0, 0).otherwise((g - 1) * m + within)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and per row ``next_text``; buckets of rows that are near in doc_id,
    each with a ghost row at its end.  Adds the window's own columns bucket, ghost, key."""
    spark = docs.sparkSession
    d = pick(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_KEY)).alias("key"))
    bounds = _ranges(d.select("key"), min(4096, 8 * partitions(spark)))
    d = d.withColumn("bucket", _bucket(bounds).cast("int"))
    firsts = {r.bucket: r.key for r in d.groupBy("bucket").agg(F.min("key").alias("key")).collect()}  # one row per bucket
    if firsts:
        order = sorted(firsts)
        after = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
        to = F.expr("CASE " + " ".join(f"WHEN bucket = {after[b]} THEN {b}" for b in order) + " END")
        heads = d.filter(F.col("key").isin([firsts[b] for b in order])).groupBy("bucket").agg(
            F.min_by(F.struct("doc_id", "text", "key"), F.struct("key", "text")).alias("r"))
        ghosts = heads.select("r.doc_id", "r.text", "r.key", to.cast("int").alias("bucket"), F.lit(1).alias("ghost"))
        d = d.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    else:
        d = d.withColumn("ghost", F.lit(0))
    return d.withColumn("next_text", F.lead("text").over(_in_order()))


def _in_order():
    return Window.partitionBy("bucket").orderBy("ghost", "key", "text")


def compare_with_edits(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The fingerprint of every text and of its edited text, and their likenesses.

    Edited: the last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document by doc_id.  ``whole`` as in :func:`with_anchors`; without it
    the bare definition, by which two texts without a closed syncmer are like each other."""
    d = with_anchors(with_next(docs), "text", "anchors", whole)
    d = d.withColumn("set", F.array_distinct("anchors"))
    d = d.withColumn("next_set", F.lead("set").over(_in_order())).filter("ghost = 0")
    d = d.withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - half),
                                        F.substr("next_text", F.lit(1), half)))
    d = with_anchors(d, "edited", "edited_anchors", whole).withColumn("edited_set", F.array_distinct("edited_anchors"))
    return d.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                    fingerprint(F.col("anchors")).alias("fingerprint"),
                    fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
                    likeness("set", "edited_set").alias("near_edited"), likeness("set", "next_set").alias("near_next"))
