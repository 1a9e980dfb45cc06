"""Conflict-constrained best-fit packing of documents into sequences.

A document of n words is one item, or, above the capacity, as many full pieces
and a rest.  Full pieces fill a sequence each.  The other items go in decreasing
size to the open bin with the smallest residual that takes them and has no
conflict: a bin holds one document of a source and one of a duplicate cluster
(texts that are equal but for case and white space).  Bins stand in order of their
residuals; each carries a bitmap of its sources and one of its clusters, and the
search starts at the first bin that is large enough and goes on to its successors
until a compatible one - the tightest - is found, or a new bin is opened.

Items are numbered in order of their values - cluster, document, source, piece - and dealt to
parts of at most about ``PART_ROWS`` in turn, so the packing does not depend on the file
split, and neighbours in that order - a cluster's copies, a hot document's pieces - spread over all
parts.  Each part is packed on its own in one task, from narrow rows (no texts).  Loss
against one large packing: the open bins at the end of each part.

Defined cases: null text or one without words is an item of 0 words that goes to a
bin like any other; a null source is a source of its own; a null doc_id is packed; rows that
repeat are packed each, and as copies never share a bin; ties go by the number above; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytics.llm.common import WORD, kept, pick, share
from shoplytics.operators.ordering import row_number

CAPACITY = 2048
PART_ROWS = 8192
#: Bins looked at in one step of the search.
_STEP = 512


def items(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, source, cluster, piece, word_start, words: narrow rows, one per piece."""
    d = pick(docs, "doc_id", "text", "source").withColumn("text", F.coalesce("text", F.lit("")))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    plain = F.lower(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    d = d.select("doc_id", "source", F.xxhash64(plain).alias("cluster"), words.alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / capacity) - 1).cast("int")
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * capacity
    return d.select("doc_id", "source", "cluster", "piece", start.alias("word_start"),
                    F.least(F.col("n") - start, F.lit(capacity)).cast("long").alias("words"))


class _Bits:
    """A bitmap per bin over numbered keys: words of 64 bits, bins along the second axis."""

    def __init__(self, keys: np.ndarray, bins: int):
        self.bits = np.zeros((keys.max(initial=-1) // 64 + 1, bins), dtype=np.uint64)
        self.keys = keys

    def free(self, item: int, bins: np.ndarray) -> np.ndarray:
        k = self.keys[item]
        return np.ones(len(bins), dtype=bool) if k < 0 else (self.bits[k // 64, bins] >> np.uint64(k % 64)) & np.uint64(1) == 0

    def put(self, item: int, bin_: int) -> None:
        k = self.keys[item]
        if k >= 0:
            self.bits[k // 64, bin_] |= np.uint64(1) << np.uint64(k % 64)


def _numbered(values: pd.Series) -> np.ndarray:
    """0, 1, ... for the values that repeat, -1 for the rest: only they can conflict."""
    counts = values.map(values.value_counts(dropna=False)) if len(values) else values
    codes = np.full(len(values), -1)
    repeated = (counts > 1).to_numpy()
    codes[repeated] = pd.factorize(values[repeated], use_na_sentinel=False)[0]
    return codes


def best_fit(sizes: np.ndarray, sources: pd.Series, clusters: pd.Series, capacity: int) -> np.ndarray:
    """The bin of each item; items are taken in the given order."""
    n = len(sizes)
    source, cluster = _Bits(_numbered(sources), n), _Bits(_numbered(clusters), n)
    residual = np.empty(n, dtype=np.int64)  # ascending, of the open bins
    order = np.empty(n, dtype=np.int64)  # the bins in that order
    open_, bin_of, next_bin = 0, np.empty(n, dtype=np.int64), 0
    for i in range(n):
        size = int(sizes[i])
        at, found = int(np.searchsorted(residual[:open_], size)), -1
        while at < open_:
            some = order[at:min(open_, at + _STEP)]
            fits = np.flatnonzero(source.free(i, some) & cluster.free(i, some))
            if len(fits):
                found = at + int(fits[0])
                break
            at += _STEP
        if found >= 0:
            b, left = int(order[found]), int(residual[found]) - size
            # Take the bin out, and put it back at its new place further down.
            to = int(np.searchsorted(residual[:found], left))
            residual[to + 1:found + 1] = residual[to:found].copy()
            order[to + 1:found + 1] = order[to:found].copy()
        else:
            b, left = next_bin, capacity - size
            next_bin += 1
            to = int(np.searchsorted(residual[:open_], left))
            residual[to + 1:open_ + 1] = residual[to:open_].copy()
            order[to + 1:open_ + 1] = order[to:open_].copy()
            open_ += 1
        residual[to], order[to] = left, b
        source.put(i, b)
        cluster.put(i, b)
        bin_of[i] = b
    return bin_of


# doc_id goes through pandas as a string: a long column with a null would come as rounded floats.
_OUT = "bin string, position int, doc_id string, source string, piece int, word_start long, words long"


def pack(docs: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """bin, position, doc_id, source, piece, word_start, words: which words of which
    document stand where.  ``bin`` names the part and its bin."""
    spark = docs.sparkSession
    all_ = row_number(items(docs, capacity), ["cluster", "doc_id", "source", "piece"], "number")
    all_ = kept(all_.withColumn("doc_id", F.col("doc_id").cast("long").cast("string")))
    n = share(spark, all_.count(), part_rows)

    def packed(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["words", "number"], ascending=[False, True], kind="stable")
        whole = (p["words"] == capacity).to_numpy()
        full, rest = p[whole], p[~whole]
        bins = np.concatenate([-1 - np.arange(len(full)), best_fit(rest["words"].to_numpy(), rest["source"], rest["cluster"], capacity)])
        p = pd.concat([full, rest])
        p["bin"] = [f"{key[0]}-{b}" if b >= 0 else f"{key[0]}f{-b}" for b in bins.astype(int)]
        p["position"] = p.groupby("bin").cumcount()
        return p[[c.split()[0] for c in _OUT.split(", ")]]

    dealt = all_.withColumn("part", F.pmod("number", F.lit(n)).cast("int"))
    out = dealt.groupBy("part").applyInPandas(lambda key, p: packed(key, p), _OUT)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def sequences(docs: DataFrame, capacity: int = CAPACITY) -> Iterator | DataFrame:
    """One row per sequence: bin, words, documents array<struct<doc_id, piece, word_start, words>>."""
    at = pack(docs, capacity)
    return at.groupBy("bin").agg(F.sum("words").alias("words"), F.sort_array(F.collect_list(
        F.struct("position", "doc_id", "piece", "word_start", "words"))).alias("documents"))
