"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, stored


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return salted_join(both, low, "u", F.col("v"), stored(hot_keys(both, "u", 2 * n), "hot")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(down, low, "u", F.col("v"), stored(hot_keys(down, "u", n), "hot")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(u, v) undirected edges of long ids -> (node, root): root is the smallest node of the component.

    Self-loops, repeated edges and null ends are ignored; an empty input gives an empty result; nodes without an edge don't
    appear. Every step is an aggregate and an equi-join on shuffled keys, a hub's links split into parts; no list of links or
    members reaches the driver. Rounds grow with the logarithm of the longest path; each is written to the shared folder.
    """
    now = stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        now = stored(_large_star(now, now.count()), "edges")
        now = stored(_small_star(now, now.count()), "edges")
        mark = now.agg(F.count("*"), F.coalesce(F.sum((F.xxhash64("u", "v") % 1000003).cast("long")), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).head()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
