"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import checkpointed


def _lesser(pairs: DataFrame) -> DataFrame:
    """(u, m): the least node among u and its neighbours, from (u, v) rows."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that a link (a, b) names; component: the least node reachable.

    Alternates large and small stars: every round hangs a node's neighbours on
    the least one, so paths shorten by halves while the number of links never
    grows. A round is two aggregations with map-side combining and two joins; a
    star's centre, with all links of a group, is a join key that can be split. Each
    round is kept in the shared checkpoint folder. Nulls and loops are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v and a is not null and b is not null").distinct()
    edges = checkpointed(edges)
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each greater neighbour of u goes to the least of u's neighbourhood
        large = both.filter("v > u").join(_lesser(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours go to the least of them
        least = _lesser(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components aren't final after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
