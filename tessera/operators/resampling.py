"""Bootstrap and permutation tests by weights: a replicate gives each unit a weight of its own.

A unit's weight in a replicate comes from a hash of both (Poisson of mean 1 for the bootstrap,
a sign for permutations), so it is the same in any engine, group and partitioning, and no
unit has to be numbered or drawn by a join. A task turns its units into a matrix of weights,
some rows at a time, and multiplies it with their values: it sends one vector of the
replicates' sums a group, whatever the number of units. The vectors are added by blocks of
replicates.

A unit's hash is a place on a circle of 2**32, and each replicate moves it by one. Where
units lie dense, the weights of a span of places are made once and all replicates' sums come
from one product of spectra (a correlation), so the work has a bound, 2**32 places a group,
beyond which more units cost a shuffled row each and not a row of weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.statistics import hashed

#: Replicates of one row of sums.
BLOCK = 2000
#: Cells of a task's matrix of weights.
CELLS = 1 << 17
#: Up to so many groups, their values are one matrix.
TOGETHER = 16
#: Poisson(1) weights by 16 bits of a hash: the shares of 65536 at or below 0, 1, ... 7.
SHARES = (24109, 48219, 60274, 64292, 65296, 65497, 65531, 65535)
#: What a replicate's number is multiplied by, and its inverse in 32 bits.
STEP = 2654435761
BACK = pow(STEP, -1, 1 << 32)
#: Length of a row of weights that is multiplied as a spectrum. A span of places with at least so many units, and so many more for each group and value, is.
SPAN, DENSE, DENSE_MORE = 1 << 16, 20, 11
_WEIGHTS = np.searchsorted(np.array(SHARES), np.arange(1 << 16), side="right").astype(np.float32)


def mixed(unit: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """32 bits of each pair of a unit's 32 bits and a replicate's number."""
    return _stirred(unit.astype(np.uint32) + replicate.astype(np.uint32) * np.uint32(STEP))


def spread(place: np.ndarray) -> np.ndarray:
    """``mixed`` of a unit and a replicate, from the sum of the unit's place and the replicate's number."""
    return _stirred(place.astype(np.uint32) * np.uint32(STEP))


def _stirred(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(16)
    x *= np.uint32(2146121005)
    x ^= x >> np.uint32(15)
    x *= np.uint32(2221713035)
    x ^= x >> np.uint32(16)
    return x


def poisson(bits: np.ndarray) -> np.ndarray:
    return _WEIGHTS[bits >> np.uint32(16)]


def signs(bits: np.ndarray) -> np.ndarray:
    return 1 - 2 * (bits & np.uint32(1)).astype(np.float32)


def _placed(unit: Column) -> Column:
    """Where a unit's replicates begin: its weight in replicate b is a function of (place + b) * STEP in 32 bits."""
    high, low = F.shiftright(unit, 16), unit.bitwiseAND(0xFFFF)
    return (F.shiftleft((high * BACK).bitwiseAND(0xFFFF), 16) + low * BACK).bitwiseAND(0xFFFFFFFF)


def weighted_sums(units: DataFrame, group: Sequence[str], key: str, values: Sequence[str], replicates: int, weights: Callable = poisson, seed: int = 0) -> DataFrame:
    """(group, rep, values): each replicate's sum of weight times value.

    Rows of one ``key`` have one weight in a replicate, in all groups; null values count as 0.
    """
    kinds = [(g, units.schema[g].dataType.simpleString()) for g in group]
    place = _placed(hashed(F.lit(seed), F.col(key)))
    rows = units.select(*group, place.alias("place"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    span = SPAN - replicates + 1 if 2 * replicates <= SPAN else SPAN
    rows = rows.withColumn("span", F.floor(F.col("place") / span).cast("int"))
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # at most 2**32 / span spans, evenly hit: a task has neighbouring ones, in order
    rows = rows.repartition(tasks, "span").sortWithinPartitions("span", "place")
    every, step = np.arange(replicates, dtype=np.uint32), max(1, CELLS // replicates)
    size = 1 << (span + replicates - 2).bit_length()
    mean = float(weights(np.arange(1 << 16, dtype=np.uint32) << np.uint32(16) | np.arange(1 << 16, dtype=np.uint32)).mean())

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[tuple, int] = {}
        sums: list[np.ndarray] = []  # of each group, sums of products
        waves: list[np.ndarray | None] = []  # of each group, the same of dense spans, as a spectrum
        whole: list[np.ndarray] = []  # and their values' sums

        def few(place: np.ndarray, name: np.ndarray, value: np.ndarray) -> None:
            """Units by rows of weights, those of one unit made once for all groups."""
            fresh = np.r_[True, place[1:] != place[:-1]]
            own, at = place[fresh], np.cumsum(fresh) - 1
            for start in range(0, len(own), step):
                some = slice(*np.searchsorted(at, [start, start + step]))
                made = weights(spread(own[start : start + step, None] + every[None, :]))
                kinds_here, row = name[some], at[some] - start
                if len(names) <= TOGETHER:
                    cells = np.zeros((len(names), len(values), len(made)))
                    np.add.at(cells, (kinds_here, slice(None), row), value[some])
                    for k, total in enumerate((cells.reshape(-1, len(made)) @ made).reshape(len(names), len(values), -1)):
                        sums[k] += total
                else:
                    for k in np.unique(kinds_here):
                        mine = kinds_here == k
                        sums[k] += value[some][mine].T @ made[row[mine]]

        def many(start: int, place: np.ndarray, name: np.ndarray, value: np.ndarray) -> None:
            """A span full of units: the weights of all its places are one row, and a replicate shifts it by one."""
            row = np.zeros(size)
            row[: span + replicates - 1] = weights(spread(np.arange(start, start + span + replicates - 1, dtype=np.uint64).astype(np.uint32))) - mean
            row = np.fft.rfft(row)
            at = (place - np.uint32(start)).astype(np.int64)
            for k in np.unique(name):
                mine = name == k
                found = np.stack([np.bincount(at[mine], weights=value[mine, c], minlength=size) for c in range(len(values))])
                whole[k] += value[mine].sum(axis=0)
                product = np.fft.rfft(found).conj() * row
                waves[k] = product if waves[k] is None else waves[k] + product

        def settled(span_: np.ndarray, place: np.ndarray, name: np.ndarray, value: np.ndarray) -> None:
            """Whole spans: those of few units together, each other one for itself."""
            cuts = np.r_[np.nonzero(np.diff(span_, prepend=span_[:1] - 1))[0], len(span_)]
            sizes = np.diff(cuts)
            cells = np.add.reduceat(np.r_[True, place[1:] != place[:-1]].astype(int), cuts[:-1])
            dense = cells >= DENSE + DENSE_MORE * len(names) * len(values)
            rest = np.repeat(~dense, sizes)
            if rest.any():
                few(place[rest], name[rest], value[rest])
            for i in np.nonzero(dense)[0]:
                some = slice(cuts[i], cuts[i + 1])
                many(int(span_[cuts[i]]) * span, place[some], name[some], value[some])

        held: list[tuple] = []
        for frame in frames:
            if not len(frame):
                continue
            name = np.zeros(len(frame), dtype=np.int64)
            if group:
                codes = frame.groupby(list(group), dropna=False, sort=False).ngroup().to_numpy()
                _, first = np.unique(codes, return_index=True)
                found = [tuple(None if pd.isna(n) else n for n in row) for row in frame[list(group)].iloc[first].itertuples(index=False, name=None)]
            else:
                codes, found = name, [()]
            for n in found:
                if n not in names:
                    names[n] = len(names)
                    sums.append(np.zeros((len(values), replicates)))
                    waves.append(None)
                    whole.append(np.zeros(len(values)))
            name = np.array([names[n] for n in found])[codes]
            held.append((frame["span"].to_numpy(), frame["place"].to_numpy().astype(np.uint32), name, frame[list(values)].to_numpy(dtype=float)))
            last = held[-1][0][-1]
            if held[0][0][0] != last:  # the last span may go on
                now = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(now[0], last))
                settled(*(c[:cut] for c in now))
                held = [tuple(c[cut:] for c in now)]
        if held:
            settled(*(np.concatenate(c) for c in zip(*held, strict=True)))
        for k, wave in enumerate(waves):
            if wave is not None:
                sums[k] += np.fft.irfft(wave, size)[:, :replicates] + mean * whole[k][:, None]
        out = [(*name, at // BLOCK, sums[k][:, at : at + BLOCK].T.astype("<f8").tobytes()) for name, k in names.items() for at in range(0, replicates, BLOCK)]
        yield pd.DataFrame(out, columns=[*group, "block", "sums"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(bytes(b), "<f8") for b in frame["sums"]).reshape(-1, len(values))
        out = pd.DataFrame(total, columns=list(values))
        out.insert(0, "rep", int(frame["block"].iloc[0]) * BLOCK + np.arange(len(total)))
        for i, (g, _) in enumerate(kinds):
            out.insert(i, g, [frame[g].iloc[0]] * len(total))
        return out

    own = "".join(f"`{g}` {t}, " for g, t in kinds)
    partial = rows.mapInPandas(vectors, f"{own}block int, sums binary")
    return partial.groupBy(*group, "block").applyInPandas(added, f"{own}rep long, " + ", ".join(f"`{v}` double" for v in values))


def replicated(items: DataFrame, group: Sequence[str], key: str, value: str, replicates: int, weight: str | None = None, seed: int = 0) -> DataFrame:
    """(group, rep, v): each replicate's mean of ``value`` (ratio of the sums of ``value`` and ``weight``), to nine places; null where it has no unit."""
    items = items.withColumn("__one", F.lit(1.0) if weight is None else F.col(weight))
    sums = weighted_sums(items, group, key, [value, "__one"], replicates, seed=seed)
    return sums.select(*group, "rep", F.round(F.try_divide(F.col(value), F.col("__one")), 9).alias("v"))


def ordered_interval(statistics: DataFrame, group: Sequence[str], level: float = 0.95) -> DataFrame:
    """(group, low, high): of B replicates that aren't null those at places floor((1 - level) / 2 * B) and floor((1 + level) / 2 * B), counted from 0."""
    values = F.sort_array(F.collect_list("v"))
    size = F.count("v")
    at = lambda share: F.get(values, F.least(size - 1, F.floor(F.round(share * size, 9))).cast("int"))
    return statistics.groupBy(*group).agg(at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))


def two_sided(statistics: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, p): twice the lesser share of replicates at or beyond 0."""
    return statistics.groupBy(*group).agg(F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("v") <= 0).cast("int")), F.avg((F.col("v") >= 0).cast("int")))).alias("p"))


def paired(items: DataFrame, group: Sequence[str], key: str, diff: str, replicates: int) -> DataFrame:
    """(group, n, diff, d, low, high, p) of paired differences; d by the deviation of all, null where it is 0."""
    point = items.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.avg(diff), 9).alias("diff"), F.round(F.try_divide(F.avg(diff), F.round(F.stddev_pop(diff), 12)), 9).alias("d"))
    stats = replicated(items, group, key, diff, replicates)
    return point.join(ordered_interval(stats, group), list(group)).join(two_sided(stats, group), list(group))


def sign_test(items: DataFrame, group: Sequence[str], key: str, diff: str, replicates: int, seed: int = 0) -> DataFrame:
    """(group, n, observed, p): the sum of differences against sums under random signs; p = (hits + 1) / (replicates + 1).

    Sums are compared to nine places, so a difference's parts may come in any order.
    """
    seen = items.groupBy(*group).agg(F.count("*").alias("n"), F.round(F.abs(F.sum(diff)), 9).alias("observed"))
    sums = weighted_sums(items, group, key, [diff], replicates, signs, seed).withColumn("v", F.round(F.abs(F.col(diff)), 9)).select(*group, "v")
    hits = sums.join(F.broadcast(seen), list(group)).groupBy(*group).agg(F.count_if(F.col("v") >= F.col("observed")).alias("hits"))
    return seen.join(hits, list(group)).withColumn("p", (F.col("hits") + 1) / F.lit(replicates + 1)).drop("hits")


def ratio_interval(clusters: DataFrame, group: Sequence[str], key: str, replicates: int, seed: int = 0) -> DataFrame:
    """(group, mean, clusters, low, high): the ratio sum(s) / sum(n) with its percentile interval over clusters, aggregated before to one (s, n) each."""
    stats = replicated(clusters, group, key, "s", replicates, "n", seed)
    bounds = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
    point = clusters.groupBy(*group).agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("clusters"))
    return point.join(stats.groupBy(*group).agg(F.round(bounds[0], 9).alias("low"), F.round(bounds[1], 9).alias("high")), list(group))



#: Replicates of the registered queries.
DRAWS = 10_000
_UNIT = "('0x' || substr(md5({}), 1, 8))::UBIGINT"


def _bits_sql(units: str, group: str, key: str, values: str, name: str, replicates: int) -> str:
    """CTEs: ``name``_x has each unit's ``x``, the 32 bits of ``mixed``, in replicate b."""
    whole, number = "4294967295::UBIGINT", lambda n: f"{n}::UBIGINT"
    return f""", {name}_1 AS (SELECT {group}, {values}, {_UNIT.format(f"'0:' || {key}")} AS h FROM {units}),
{name}_2 AS (SELECT * EXCLUDE (h), (h + b * {number(2654435761)}) & {whole} AS x FROM {name}_1, (SELECT unnest(range({replicates}))::UBIGINT AS b)),
{name}_3 AS (SELECT * REPLACE ((xor(x, x >> {number(16)}) * {number(2146121005)}) & {whole} AS x) FROM {name}_2),
{name}_4 AS (SELECT * REPLACE ((xor(x, x >> {number(15)}) * {number(2221713035)}) & {whole} AS x) FROM {name}_3),
{name}_x AS (SELECT * REPLACE (xor(x, x >> {number(16)}) AS x) FROM {name}_4)"""


def replicated_sql(units: str, group: str, key: str, value: str, weight: str = "1", name: str = "v", replicates: int = DRAWS) -> str:
    """DuckDB CTEs of ``replicated``: ``name`` has (group, b, v)."""
    w = " + ".join(f"(x >> 16::UBIGINT >= {share}::UBIGINT)::INT" for share in SHARES)
    return _bits_sql(units, group, key, f"{value} AS num, {weight} AS den", name, replicates) + f""",
{name}_w AS (SELECT * EXCLUDE (x), {w} AS w FROM {name}_x), {name} AS (SELECT {group}, b, round(sum(w * num) / nullif(sum(w * den), 0), 9) AS v FROM {name}_w GROUP BY ALL)"""


def signed_sql(units: str, group: str, key: str, diff: str, replicates: int = DRAWS) -> str:
    """DuckDB CTEs of ``sign_test``: sign_p has (group, n, observed, p)."""
    return _bits_sql(units, group, key, f"{diff} AS d", "sign", replicates) + f""",
sign_v AS (SELECT {group}, b, round(abs(sum(CASE WHEN x & 1::UBIGINT = 0 THEN d ELSE -d END)), 9) AS v FROM sign_x GROUP BY ALL), sign_s AS (SELECT {group}, count(*) AS n, round(abs(sum({diff})), 9) AS observed FROM {units} GROUP BY ALL),
sign_p AS (SELECT {group}, n, observed, (sum((v >= observed)::INT) + 1) / {replicates + 1} AS p FROM sign_v JOIN sign_s USING ({group}) GROUP BY ALL)"""
