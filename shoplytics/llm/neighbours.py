"""Approximate nearest neighbours with a hash-prefix forest.

Every vector has ``TREES`` long hash strings of ``BITS`` signs of random
projections.  A tree is the sorted array of the hash strings of a block of vectors;
the vectors that share a prefix with a query's string are one slice of it.

Search, per query and block: descend in every tree to the longest matching prefix,
then ascend in all trees together, one bit at a time, taking the slices' vectors as
candidates, until (1) there are k, and (2) a vector as near as the k-th so far would
have been met with probability ``RECALL`` or more.  With angle t between the two,
one sign agrees with probability p = 1 - t / pi, so a tree misses at depth d
with 1 - p ** d, all trees with (1 - p ** d) ** TREES.  The angle is the largest that
the norms in the block allow at that distance.  At depth 0 every vector is met, so
data in which neighbours hardly differ from the rest is searched whole, and clustered
data at great depth: the number of candidates has no cap and follows the data.
Candidates are measured exactly, in double precision.

The job: vectors go to blocks of about ``BLOCK`` rows by a hash of vec_id, queries to
groups of ``QUERIES``; each (block, group) is one task's work of bounded size, and the
nearest of the blocks meet in a window per query (k rows a block).  Every row is
indexed, none is sampled; hash planes come from a fixed seed.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither as query nor as candidate; vectors of another length than
the query's are no candidates; equal distances go by vec_id; rows that repeat a
vec_id are one vector (the first by components); null vec_id takes no part; fewer
than k candidates give all of them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplytics.llm.common import kept, pick, share

K = 10
TREES, BITS = 24, 24
RECALL = 0.97
BLOCK, QUERIES = 8192, 1024


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def planes(dim: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, TREES * BITS)).astype(np.float32)


def hashes(x: np.ndarray) -> np.ndarray:
    """One row per tree: the hash strings as integers, first sign highest."""
    signs = (x.astype(np.float32) @ planes(x.shape[1]) >= 0).reshape(len(x), TREES, BITS)
    return (signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).T


class Forest:
    """The sorted arrays of one block."""

    def __init__(self, x: np.ndarray):
        self.x = x
        h = hashes(x)
        self.order = np.argsort(h, axis=1, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, axis=1)
        norms = np.sqrt((x * x).sum(1))
        self.shortest, self.longest = norms.min(), norms.max()

    def slices(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(depth, tree, query): where the prefixes of the queries' strings begin and end."""
        lo = np.empty((BITS + 1, *h.shape), dtype=np.int64)
        hi = np.empty_like(lo)
        for t in range(TREES):
            for d in range(BITS + 1):
                low = (h[t] >> (BITS - d)) << (BITS - d)
                lo[d, t] = np.searchsorted(self.sorted[t], low)
                hi[d, t] = np.searchsorted(self.sorted[t], low + (1 << (BITS - d)))
        return lo, hi

    def agree(self, norm: float, distance: float) -> float:
        """The least probability that a sign of a vector at that distance agrees."""
        s = np.clip(np.sqrt(max(0.0, norm * norm - distance * distance)), self.shortest, self.longest)
        cos = min((norm * norm + v * v - distance * distance) / (2 * norm * v) for v in (s, self.shortest, self.longest))
        return 1 - np.arccos(np.clip(cos, -1, 1)) / np.pi

    def search(self, q: np.ndarray, h: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per query: places and distances of the k nearest candidates.  ``own``: the query's place or -1."""
        lo, hi = self.slices(h)
        for i in range(len(q)):
            norm = float(np.sqrt(q[i] @ q[i]))
            met = np.zeros(len(self.x), dtype=bool)
            if own[i] >= 0:
                met[own[i]] = True
            places, far = np.empty(0, dtype=np.int64), np.empty(0)
            size = (hi[:, :, i] - lo[:, :, i]).sum(1)
            # Descend to where the prefixes first hold k vectors (and the query itself) in all.
            depth = int(np.flatnonzero(size >= min(k + 1, len(self.x)))[-1])
            while True:
                new = np.zeros(len(self.x), dtype=bool)
                for t in range(TREES):
                    new[self.order[t, lo[depth, t, i]:hi[depth, t, i]]] = True
                new = np.flatnonzero(new & ~met)
                met[new] = True
                diff = self.x[new] - q[i]
                places, far = np.concatenate([places, new]), np.concatenate([far, np.sqrt((diff * diff).sum(1))])
                if len(far) > k:
                    # All that tie with the k-th stay: vec_id decides later.
                    best = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
                    places, far = places[best], far[best]
                if depth == 0:
                    break
                if len(far) >= k:
                    p = self.agree(norm, float(np.partition(far, k - 1)[k - 1]))
                    enough = np.flatnonzero((1 - p ** np.arange(depth + 1)) ** TREES <= 1 - RECALL)
                    if enough[-1] == depth:
                        break
                    depth = int(enough[-1])  # the levels between would only be passed
                else:
                    depth -= 1
            yield places, far


def search(rows: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found, for the rows where ``queries`` holds."""
    spark = rows.sparkSession
    v = pick(rows, "vec_id", "embedding").withColumn("x", F.col("embedding").cast("array<double>"))
    v = v.filter(F.col("vec_id").isNotNull() & usable(F.col("x"))).groupBy("vec_id").agg(F.min("x").alias("x"))
    v = kept(v.withColumn("q", queries))
    sizes = v.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, groups = share(spark, sizes.n, BLOCK), share(spark, sizes.q, QUERIES)
    by = lambda salt, n: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = v.select(by("block", blocks).alias("block"), every(groups).alias("group"), "vec_id", "x")
    asked = v.filter("q").select(every(blocks).alias("block"), by("group", groups).alias("group"), "vec_id", "x")

    def found(asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        dims = index["x"].map(len)
        for dim, part in asked.groupby(asked["x"].map(len)):
            same = index[dims == dim].sort_values("vec_id")
            if not len(same):
                continue
            x, q = np.stack(same["x"].to_numpy()).astype(np.float64), np.stack(part["x"].to_numpy()).astype(np.float64)
            ids, qids = same["vec_id"].to_numpy(), part["vec_id"].to_numpy()
            place = np.minimum(np.searchsorted(ids, qids), len(ids) - 1)
            own = np.where(ids[place] == qids, place, -1)
            for qid, (at, far) in zip(qids, Forest(x).search(q, hashes(q), own, k)):
                first = np.lexsort((ids[at], far))[:k]
                out.append((np.full(len(first), qid), ids[at][first], far[first]))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"query_id": a.astype("int64"), "vec_id": b.astype("int64"), "score": c})

    met = asked.groupBy("block", "group").cogroup(index.groupBy("block", "group")).applyInPandas(
        found, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
