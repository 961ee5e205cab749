"""Rank statistics, agreement, resampling and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.keeping import kept


def hashed(*parts: Column) -> Column:
    """A number below 2**32 from the MD5 of parts joined by colons, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def average_rank(value: Column, within: Sequence[str] = ()) -> Column:
    """Rank with ties at their mean."""
    ties = Window.partitionBy(*within, value)
    return F.rank().over(Window.partitionBy(*within).orderBy(value)) + (F.count("*").over(ties) - 1) / 2


def all_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, k, rank) of every distinct value: rows that have it, and their mean rank among all rows, nulls first.

    Values' counts are dealt out by range; a task ranks its own, behind the rows of the tasks before it.
    """
    counts = rows.groupBy(value).agg(F.count("*").alias("k"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = kept(counts.repartitionByRange(tasks, value).withColumn("__task", F.spark_partition_id()))
    sums = counts.groupBy("__task").agg(F.sum("k").alias("s"))
    ahead = sums.select("__task", F.coalesce(F.sum("s").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row a task
    here = F.coalesce(F.sum("k").over(Window.partitionBy("__task").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("__here", here).join(F.broadcast(ahead), "__task").select(value, "k", (F.col("ahead") + F.col("__here") + (F.col("k") + 1) / 2).alias("rank"))


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) of average ranks, also with ties; 0 below three rows. Without keys all rows are ranked by ``all_ranks``."""
    n = F.count("*")
    if keys:
        ranked = rows.withColumn("__d", average_rank(F.col(x), keys) - average_rank(F.col(y), keys))
        return ranked.groupBy(*keys).agg(F.when(n < 3, 0.0).otherwise(1 - 6 * F.sum(F.col("__d") * F.col("__d")) / (n * (n * n - 1))).alias("rho"), n.alias("n"))
    cells = rows.groupBy(F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__n"))
    for c, name in ((x, "__x"), (y, "__y")):
        ranks = all_ranks(rows, c).select(F.col(c).alias("__v"), F.col("rank").alias(f"{name}_rank"))
        cells = cells.join(ranks, F.col(name).eqNullSafe(F.col("__v"))).drop("__v")
    d, n = F.col("__x_rank") - F.col("__y_rank"), F.coalesce(F.sum("__n"), F.lit(0)).cast("double")
    return cells.agg(F.when(n < 3, 0.0).otherwise(1 - F.try_divide(6 * F.sum(d * d * F.col("__n")), n * (n * n - 1))).alias("rho"), n.cast("long").alias("n"))


def holm(tests: DataFrame, family: Sequence[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down: adjusted = running greatest of (m - rank + 1) p, at most 1; reject below alpha."""
    order = Window.partitionBy(*family).orderBy(p)
    m, k = F.count("*").over(Window.partitionBy(*family)), F.row_number().over(order)
    scaled = tests.withColumn("__s", (m - k + 1) * F.col(p)).withColumn("threshold", F.lit(alpha) / (m - k + 1))
    adjusted = F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return scaled.withColumn("adjusted", adjusted).withColumn("reject", F.col("adjusted") < alpha).drop("__s")


def cohen_kappa(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Nominal kappa of two raters: chance agreement of 1 gives 1, no item 0."""
    cells = pairs.groupBy(*keys, a, b).agg(F.count("*").alias("k"))
    rows = cells.groupBy(*keys, a).agg(F.sum("k").alias("ra")).withColumnRenamed(a, "__v")
    cols = cells.groupBy(*keys, b).agg(F.sum("k").alias("rb")).withColumnRenamed(b, "__v")
    chance = rows.join(cols, [*keys, "__v"]).groupBy(*keys).agg(F.sum(F.col("ra") * F.col("rb")).alias("e"))
    agree = cells.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("k")).otherwise(0)).alias("o"))
    both = agree.join(chance, list(keys), "left") if keys else agree.crossJoin(F.broadcast(chance))  # without keys one row each
    po, pe = F.col("o") / F.col("n"), F.coalesce(F.col("e"), F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select(*keys, "n", po.alias("agreement"), F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, item: str, rating: str) -> DataFrame:
    """Nominal kappa of items that the usual number of raters (the modal one, the greater on a tie) rated."""
    counts = ratings.groupBy(item, rating).agg(F.count("*").alias("k"))
    items = counts.groupBy(item).agg(F.sum("k").alias("raters"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same"))
    usual = items.groupBy("raters").agg(F.count("*").alias("c")).agg(F.max_by("raters", F.struct("c", "raters")).alias("usual"))
    kept = items.crossJoin(F.broadcast(usual)).filter("raters = usual and raters >= 2")  # one row
    observed = kept.agg(F.count("*").alias("items"), F.first("raters").alias("raters"), F.avg(F.col("same") / (F.col("raters") * (F.col("raters") - 1))).alias("po"))
    shares = counts.join(kept.select(item, F.col("raters")), item).groupBy(rating).agg(F.sum("k").alias("s"))
    chance = shares.agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.sum("s").alias("t"))
    pe = F.col("q") / (F.col("t") * F.col("t"))
    return observed.crossJoin(F.broadcast(chance)).select("items", "raters", F.when(pe >= 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def majority_vote(rows: DataFrame, keys: Sequence[str], value: Column, order: str, score: str) -> DataFrame:
    """The most frequent value of each group, ties to the one met first in ``order``; right if a winner's score is at least a half."""
    votes = rows.withColumn("__v", value).groupBy(*keys, "__v").agg(F.count("*").alias("votes"), F.min(order).alias("first"), F.max(score).alias("top"))
    best = votes.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "first"))).filter("__rn = 1")
    return best.select(*keys, F.col("__v").alias("winner"), "votes", (F.col("top") >= 0.5).cast("double").alias("right"))


def ensemble(rows: DataFrame, keys: Sequence[str], value: Column, order: str, score: str) -> DataFrame:
    """``majority_vote``'s ``right`` of each group beside the mean, greatest and least score of all its rows, from one grouping by value."""
    votes = rows.withColumn("__v", value).groupBy(*keys, "__v").agg(F.count("*").alias("votes"), F.min(order).alias("first"), F.max(score).alias("top"), F.min(score).alias("low"), F.sum(score).alias("sum"), F.count(score).alias("n"))
    group = Window.partitionBy(*keys)
    every = group.orderBy(F.desc("votes"), "first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = votes.withColumns({"__rn": F.row_number().over(group.orderBy(F.desc("votes"), "first")), "mean": F.try_divide(F.sum("sum").over(every), F.sum("n").over(every)), "best": F.max("top").over(every), "worst": F.min("low").over(every)})
    return both.filter("__rn = 1").select(*keys, (F.col("top") >= 0.5).cast("double").alias("right"), "mean", "best", "worst")


def selector(train: DataFrame, test: DataFrame, by: Sequence[str], fallback: Sequence[str], choice: str, score: str, keys: Sequence[str]) -> DataFrame:
    """Format chosen by ``by`` on the training half (ties to the least name), else by ``fallback`` (some of ``by``), applied to the test half; the mean of what it finds there, else of the question."""
    def best(columns: Sequence[str], name: str) -> DataFrame:
        means = train.groupBy(*columns, choice).agg(F.avg(score).alias("m"))
        top = means.withColumn("__rn", F.row_number().over(Window.partitionBy(*columns).orderBy(F.desc("m"), choice))).filter("__rn = 1")
        return top.select(*columns, F.col(choice).alias(name))

    questions = test.groupBy(*keys, *by).agg(F.map_from_entries(F.collect_list(F.struct(choice, score))).alias("all"), F.avg(score).alias("mean"))
    both = questions.join(best(by, "__own"), list(by), "left").join(best(fallback, "__other"), list(fallback), "left")
    pick = F.coalesce("__own", "__other")
    return both.withColumn("chosen", pick).withColumn("value", F.coalesce(F.try_element_at("all", pick), F.col("mean"))).drop("all")


def quotas(strata: DataFrame, size: str, total: int, key: Sequence[str]) -> DataFrame:
    """Largest-remainder shares of ``total``: floors, then one more by fraction, ties by key. ``strata`` is one row a stratum."""
    every = Window.partitionBy()
    exact = strata.withColumn("__x", F.col(size) * F.lit(total) / F.sum(size).over(every)).withColumn("__f", F.floor("__x"))
    left = F.lit(total) - F.sum("__f").over(every)
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__x") - F.col("__f"), 9)), *key))
    return exact.withColumn("quota", (F.col("__f") + F.when(place <= left, 1).otherwise(0)).cast("long")).drop("__x", "__f")
