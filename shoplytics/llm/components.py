"""Connected components of an edge table, by alternating large and small stars.

Each round halves the distance to the smallest id at least, so long chains take
logarithmically many rounds.  Rounds are written to the shared checkpoint folder;
the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplytics.llm.common import kept, share

#: Edges that one task goes through.
PER_TASK = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins the neighbours above each node to the smallest id near it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each node (a) and its neighbours below (b) to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge, smallest node of the component.

    ``edges``: columns a and b, any direction; loops and repeats are harmless."""
    now = kept(edges.select("a", "b").filter("a <> b").distinct())
    n, before = now.count(), None
    while True:
        # Few edges need few tasks: every task of a shuffle leaves files of its own.
        near = now.coalesce(share(now.sparkSession, n, PER_TASK))
        now = kept(_small_star(_large_star(near)))
        mark = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h")).first()
        if mark == before:
            break
        n, before = mark["n"], mark
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
