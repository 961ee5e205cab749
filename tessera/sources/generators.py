"""Seeded series, graphs and tables, each value from a hash of the seed and its place, so the same at any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.statistics import hashed
from tessera.sources.adapters import pick

#: The patterns and kinds that datasets take in turn.
PATTERNS = ("linear_trend", "seasonal", "trend_seasonal", "random_walk", "step_function", "spike_anomaly", "gradual_drift", "multimodal")
KINDS = ("star", "grid", "tree", "ring", "random", "bipartite", "community")


def uniform(*parts) -> Column:
    """A number from 0 to 1."""
    return hashed(*[p if isinstance(p, Column) else F.lit(p) for p in parts]) / F.lit(4294967296.0)


def series(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """data_id, pattern, t, value: 50 to 200 points each."""
    i = F.col("data_id")
    sizes = spark.range(count).withColumnRenamed("id", "data_id").withColumn("n", 50 + hashed(F.lit(seed), F.lit("n"), i) % 151).withColumn("pattern", pick(PATTERNS, i % len(PATTERNS)))
    points = sizes.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("e", uniform(seed, i, F.col("t")) - 0.5)
    t, e, n = F.col("t"), F.col("e"), F.col("n")
    walk = F.sum("e").over(Window.partitionBy("data_id").orderBy("t"))
    season = 10 * F.sin(2 * F.pi() * t / 12)
    third = lambda k: F.floor(k * n / 3)
    shapes = {
        "linear_trend": 10 + 0.5 * t + e,
        "seasonal": season + e,
        "trend_seasonal": 0.3 * t + season + e,
        "random_walk": walk,
        "step_function": F.when(t < third(1), 5).when(t < third(2), 15).otherwise(8) + e,
        "spike_anomaly": e + F.when((t == F.floor(n / 4)) | (t == F.floor(n / 2)) | (t == F.floor(3 * n / 4)), 20).otherwise(0),
        "gradual_drift": 0.01 * t * t / 10 + e,
    }
    value = F.when(e < 0, 5).otherwise(15) + e
    for name, shape in shapes.items():
        value = F.when(F.col("pattern") == name, shape).otherwise(value)
    return points.select("data_id", "pattern", "t", F.round(value, 3).alias("value"))


def graphs(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """data_id, kind, src, dst: graphs of 12 to 16 nodes, src < dst."""
    i = F.col("data_id")
    sized = spark.range(count).withColumnRenamed("id", "data_id").withColumn("n", 12 + i % 5).withColumn("kind", pick(KINDS, i % len(KINDS)))
    a = sized.withColumn("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 2)))
    pairs = a.withColumn("dst", F.explode(F.sequence(F.col("src") + 1, F.col("n") - 1))).withColumn("u", uniform(seed, i, F.col("src"), F.col("dst")))
    s, d, u, half = F.col("src"), F.col("dst"), F.col("u"), F.floor(F.col("n") / 2)
    edge = F.when((s < half) == (d < half), u < 0.6).otherwise(u < 0.05)
    rules = {
        "star": s == 0,
        "grid": (d == s + 4) | ((d == s + 1) & (d % 4 != 0)),
        "tree": s == F.floor((d - 1) / 2),
        "ring": (d == s + 1) | ((s == 0) & (d == F.col("n") - 1)),
        "random": u < 0.25,
        "bipartite": (s < half) & (d >= half) & (u < 0.4),
    }
    for kind, rule in rules.items():
        edge = F.when(F.col("kind") == kind, rule).otherwise(edge)
    return pairs.filter(edge).select("data_id", "kind", "src", "dst")


def tables(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """data_id, row_idx, label, amount, units, rate: 16 to 35 rows each."""
    i = F.col("data_id")
    sized = spark.range(count).withColumnRenamed("id", "data_id").withColumn("n", 16 + hashed(F.lit(seed), F.lit("t"), i) % 20)
    rows = sized.withColumn("row_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    r = F.col("row_idx")
    return rows.select("data_id", "row_idx", F.concat(F.lit("item "), F.chr(65 + r % 26)).alias("label"), F.round(100 * uniform(seed, "a", i, r), 2).alias("amount"), (hashed(F.lit(seed), F.lit("b"), i, r) % 50).alias("units"), F.round(20 + 60 * uniform(seed, "c", i, r), 1).alias("rate"))
