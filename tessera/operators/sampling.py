"""Samples by quota. Order within a stratum is by a hash of the seed and the item's key, ties by the key."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.statistics import hashed


def first_of_each(items: DataFrame, strata: Sequence[str], order: Sequence[Column], quota: Column) -> DataFrame:
    """Of each stratum the first ``quota`` items."""
    return items.withColumn("__k", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).filter(F.col("__k") <= quota).drop("__k")


def _placed(items: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    place = hashed(F.lit(seed), F.col(key))
    return items.withColumn("__h", place).withColumn("__k", F.row_number().over(Window.partitionBy(*strata).orderBy("__h", key)))


def bucket_fill(items: DataFrame, strata: Sequence[str], key: str, total: int, seed: int) -> DataFrame:
    """total // buckets items of each bucket, at least one; then others until there are ``total``."""
    per = max(1, total // max(1, items.select(*strata).distinct().count()))
    # a bucket's items beyond the total can't be in the sample
    some = _placed(items, strata, key, seed).filter(F.col("__k") <= total)
    return some.orderBy(F.desc(F.col("__k") <= per), "__h", key).limit(total).drop("__h", "__k")


def source_mix(items: DataFrame, total: int, groups: Sequence[str], key: str, seed: int, group: str = "modality", source: str = "source", one: str = "synthetic") -> DataFrame:
    """total / groups items a group, the first groups one more; half of them from source ``one``, what a source lacks from the others."""
    share = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(g), F.lit(total // len(groups) + (i < total % len(groups))))])
    own = F.col(source) == one
    sided = _placed(items.withColumn("__own", own), [group, "__own"], key, seed).filter(F.col("__k") <= total)
    sizes = items.groupBy(group).agg(F.count_if(own).alias("__a"), F.count_if(~own).alias("__b"))
    both = sided.join(F.broadcast(sizes), group).withColumn("__t", F.try_element_at(share, F.col(group)))  # a row a group
    half = F.floor(F.col("__t") / 2)
    rest = F.col("__t") - half
    take = F.when(F.col("__own"), F.least("__a", half + F.greatest(F.lit(0), rest - F.col("__b")))).otherwise(F.least("__b", rest + F.greatest(F.lit(0), half - F.col("__a"))))
    return both.filter(F.col("__k") <= take).select(items.columns)


def even(total: int, names: Sequence) -> dict:
    return {n: total // len(names) + (i < total % len(names)) for i, n in enumerate(names)}


def deficits(sizes: Mapping[tuple, int], strata: Mapping[str, Sequence], total: int) -> dict[tuple, int]:
    """How many to take of each stratum of ``sizes``: even shares, then one by one of the stratum with items left that lacks most.

    A stratum lacks what its share, its modality, its difficulty and its source are short of, with weights 4, 2, 2 and 1
    (the columns in order, then the last one 1). Ties go to the stratum with most items left, then the least name.
    """
    targets = even(total, list(product(*strata.values())))
    sides = [even(total, values) for values in strata.values()]
    weights = [2] * (len(sides) - 1) + [1]
    taken = {s: min(n, targets.get(s, 0)) for s, n in sizes.items()}
    counts = [Counter() for _ in sides]
    for s, n in taken.items():
        for count, v in zip(counts, s, strict=True):
            count[v] += n

    def lack(s: tuple) -> int:
        return 4 * max(0, targets.get(s, 0) - taken[s]) + sum(w * max(0, side.get(v, 0) - count[v]) for w, side, count, v in zip(weights, sides, counts, s, strict=True))

    for _ in range(min(total, sum(sizes.values())) - sum(taken.values())):
        best = min((s for s in sizes if taken[s] < sizes[s]), key=lambda s: (-lack(s), taken[s] - sizes[s], tuple(map(str, s))))
        taken[best] += 1
        for count, v in zip(counts, best, strict=True):
            count[v] += 1
    return taken


def deficit_sample(items: DataFrame, strata: Mapping[str, Sequence[str]], key: str, total: int, seed: int) -> DataFrame:
    """``total`` items by ``deficits``, of each stratum the first in hash order.

    The driver sees the strata's sizes alone; items are numbered within their stratum and joined with its number.
    """
    columns = list(strata)
    sizes = {tuple(r[c] for c in columns): r["n"] for r in items.groupBy(*columns).agg(F.count("*").alias("n")).collect()}
    taken = [(*s, n) for s, n in deficits(sizes, strata, total).items() if n]
    schema = ", ".join(f"`__{c}` {items.schema[c].dataType.simpleString()}" for c in columns) + ", __take long"
    take = items.sparkSession.createDataFrame(taken, schema)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    both = _placed(items, columns, key, seed).join(F.broadcast(take), same)  # a row a stratum
    return both.filter(F.col("__k") <= F.col("__take")).select(items.columns)
