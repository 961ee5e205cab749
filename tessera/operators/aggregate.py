"""Grouped aggregates over evaluation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_scores(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str] = ("exact_match",)) -> DataFrame:
    """Mean of each metric (null as 0, 0 over no rows) and count by ``keys``."""
    aggs = [F.coalesce(F.avg(F.coalesce(F.col(m), F.lit(0.0))), F.lit(0.0)).alias(f"mean_{m}") for m in metrics]
    return rows.groupBy(*keys).agg(*aggs, F.count("*").alias("n"))


def best_and_worst(rows: DataFrame, keys: Sequence[str], choice: str, value: str, ties: str = "first") -> DataFrame:
    """Of each group the ``choice`` of greatest and of least ``value``, both, and their gap.

    Ties go to the least name (``first``) or the greatest (``last``).
    """
    names = F.col(choice)
    top = F.max(F.struct(F.col(value), names)) if ties == "last" else F.max_by(F.struct(F.col(value), names), F.struct(F.col(value), _reversed(names)))
    low = F.min(F.struct(F.col(value), names)) if ties == "first" else F.min_by(F.struct(F.col(value), names), F.struct(F.col(value), _reversed(names)))
    out = rows.groupBy(*keys).agg(top.alias("top"), low.alias("low"))
    return out.select(*keys, F.col(f"top.{choice}").alias("best"), F.col(f"low.{choice}").alias("worst"), F.col(f"top.{value}").alias("best_value"), F.col(f"low.{value}").alias("worst_value"), (F.col(f"top.{value}") - F.col(f"low.{value}")).alias("gap"))


def _reversed(name: Column) -> Column:
    """Orders names the other way round: code points from the top, a shorter prefix last."""
    return F.concat(F.transform(F.transform(F.split(name, ""), F.ascii), lambda c: F.lit(1_114_112) - c), F.array(F.lit(2_000_000)))


def pivot_means(rows: DataFrame, keys: Sequence[str], by: str, values: Sequence[str], metric: str = "exact_match") -> DataFrame:
    """One column a value of ``by``: a pivot over known values, one aggregation."""
    return rows.groupBy(*keys).agg(*[F.avg(F.when(F.col(by) == v, F.col(metric))).alias(v.replace("-", "_")) for v in values])


def majority(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column] = ()) -> DataFrame:
    """The most frequent value of each group, its share and the group's size; ties by ``order``, else by value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("k"))
    window = Window.partitionBy(*keys)
    ranked = counts.withColumn("n", F.sum("k").over(window)).withColumn("rn", F.row_number().over(window.orderBy(F.desc("k"), *(order or [F.asc(value)]))))
    return ranked.filter("rn = 1").select(*keys, F.col(value).alias("majority"), (F.col("k") / F.col("n")).alias("share"), "n")


def disagreement(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Pairs of rows in each group, and those whose values differ, from value counts: C(k,2) - sum C(n_v,2), no pair is made."""
    choose = lambda k: (k * (k - 1) / 2).cast("long")
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__k"))
    out = counts.groupBy(*keys).agg(F.sum("__k").alias("n"), F.sum(choose(F.col("__k"))).alias("same"))
    return out.select(*keys, "n", choose(F.col("n")).alias("pairs"), (choose(F.col("n")) - F.col("same")).alias("flips"))


def consistency(pairs: Column, flips: Column) -> Column:
    """Share of agreeing pairs; 1 for fewer than two rows."""
    return F.when(pairs == 0, 1.0).otherwise((pairs - flips) / pairs)


def without_each(rows: DataFrame, keys: Sequence[str], metric: str = "exact_match") -> DataFrame:
    """Leave one out: overall mean, and the mean without each group, from sums: (S - s) / (N - n)."""
    groups = rows.groupBy(*keys).agg(F.sum(metric).alias("s"), F.count("*").alias("n"))
    total = groups.agg(F.sum("s").alias("total"), F.sum("n").alias("count"))
    both = groups.crossJoin(F.broadcast(total))  # one row
    rest = F.coalesce(F.try_divide(F.col("total") - F.col("s"), F.col("count") - F.col("n")), F.lit(0.0))
    return both.select(*keys, (F.col("total") / F.col("count")).alias("baseline"), rest.alias("ablated"), (rest - F.col("total") / F.col("count")).alias("delta"))
