"""Distances of all pairs, ranks over ranges and deficits against plain versions."""

import random

import numpy as np
import pytest

from tessera.operators import pairs, sampling
from tessera.operators import statistics as st


@pytest.mark.parametrize("seed", range(6))
def test_distances(seed):
    rng = random.Random(seed)
    v = np.sort([rng.choice([rng.random() * 10, rng.randrange(4), -0.1, 0.1, 0.30000000000000004, 0.3, 1e-300]) for _ in range(rng.randrange(1, 60))])
    d = np.sort(np.abs(v[:, None] - v[None, :]).ravel())
    for place in {0, len(d) - 1, len(d) // 3, len(d) // 2}:
        assert pairs.distance_at(v, place) == d[place]
    for share in (0.0, 0.2, 0.5, 1.0):
        place = share * (len(d) - 1)
        a, b = d[int(place)], d[min(int(place) + 1, len(d) - 1)]
        assert pairs.near_pairs(v, share) == (d <= a + (b - a) * (place - int(place))).sum()
    assert pairs.near_pairs(np.array([]), 0.2) == 0


def test_long_series():
    """Some hundred thousand points, whose pairs would be ten thousand millions."""
    v = np.sort(np.random.default_rng(1).random(100_000))
    assert pairs.near_pairs(v, 0.2) == pytest.approx(0.2 * len(v) ** 2, rel=1e-6)


def test_ranks(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1.5, 2.5, rng.random(), None]), rng.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "x double, y int").repartition(5)
    values = [r[0] for r in rows]
    for r in st.all_ranks(df, "x").collect():
        less = sum((v is None and r["x"] is not None) or (v is not None and r["x"] is not None and v < r["x"]) for v in values)
        assert (r["k"], r["rank"]) == (values.count(r["x"]), less + (values.count(r["x"]) + 1) / 2)
    from pyspark.sql import functions as F

    one = st.spearman(df, [], "x", "y").first()
    other = st.spearman(df.withColumn("g", F.lit(1)), ["g"], "x", "y").first()
    assert (one["n"], round(one["rho"], 12)) == (other["n"], round(other["rho"], 12))
    assert st.spearman(df.limit(0), [], "x", "y").first()["n"] == 0


def test_deficits():
    strata = {"m": ("a", "b"), "d": ("x", "y"), "s": ("p", "q")}
    sizes = {("a", "x", "p"): 40, ("a", "y", "p"): 2, ("b", "x", "q"): 1, ("b", "y", "p"): 30, ("b", "y", "q"): 0}
    taken = sampling.deficits(sizes, strata, 40)
    assert sum(taken.values()) == 40 and all(0 <= n <= sizes[s] for s, n in taken.items())
    # shares of five each, then one at a time: a plain version that looks at every item left
    now = {s: min(n, 5) for s, n in sizes.items()}
    side = [dict.fromkeys(v, 20) for v in strata.values()]
    while sum(now.values()) < 40:
        lack = {s: 4 * max(0, 5 - now[s]) + sum(w * max(0, side[i][s[i]] - sum(n for t, n in now.items() if t[i] == s[i])) for i, w in enumerate((2, 2, 1))) for s in sizes if now[s] < sizes[s]}
        best = sorted(lack, key=lambda s: (-lack[s], now[s] - sizes[s], s))[0]
        now[best] += 1
    assert taken == now
    assert sampling.deficits(sizes, strata, 1000) == sizes


def test_quantile_to_the_last_bit():
    """Distances of decimals differ in their last bits only; the limit between two of them is SQL's."""
    import duckdb

    cents = [193, 323, 476, 562, 826, 1092, 1431, 1459, 1896, 1917, 2005, 2073, 2185, 2217, 2491, 2755, 2944, 3276, 3392, 3551, 3668, 4011, 4116, 4145, 4164, 4384, 4403, 4432, 4673, 5112, 5756, 6522, 7547, 7705, 7760, 7953, 8361, 8938, 10259, 11068, 11396, 11658, 11826, 12191, 14523, 15275, 15648, 15942, 19185, 22076]
    v = np.array(cents) / 100
    distances = np.abs(v[:, None] - v[None, :]).ravel().tolist()
    sql = "SELECT sum((d <= lim)::INT)::BIGINT FROM (SELECT unnest(?) AS d), (SELECT quantile_cont(d, 0.2) AS lim FROM (SELECT unnest(?) AS d))"
    assert pairs.near_pairs(v, 0.2) == duckdb.connect().execute(sql, [distances, distances]).fetchall()[0][0] == 500
