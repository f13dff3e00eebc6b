"""Connected components of a table of links, without collecting any of it.

Star contraction: large-star and small-star rounds replace each link by one to the
smallest neighbour until every component is a star.  A round is two aggregations
and two joins; the joins are ordinary equi-joins, so the engine splits a hub's
partition.  Each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 100


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> each u's smallest v or u itself."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """links: (a, b) with a > b.  Every neighbour larger than u is linked to u's smallest."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.join(_least(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every neighbour smaller than u, and u, are linked to u's smallest."""
    down = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a > b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node that has a link; the root is the component's
    smallest node.  ``links`` has columns a and b of one ordered type; loops and
    repeated links are harmless, rows with a null don't count.
    """
    own = Scratch(links.sparkSession)
    now = own.cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        now = own.cut(_small_star(_large_star(now)))
        own.drop(keep=1)
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if new == state:
            done = scratch.cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
            own.drop()
            return done
        state = new
    raise RuntimeError("components did not settle")
