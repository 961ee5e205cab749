"""Weights of replicates against plain loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import resampling as rs


def bits(key, rep):
    x = (int(hashlib.md5(f"0:{key}".encode()).hexdigest()[:8], 16) + rep * 2654435761) % 2**32
    x = (x ^ x >> 16) * 2146121005 % 2**32
    x = (x ^ x >> 15) * 2221713035 % 2**32
    return x ^ x >> 16


def weight(key, rep):
    return sum((bits(key, rep) >> 16) >= share for share in rs.SHARES)


ROWS = [("a", f"q{i}", float(i % 3), 1.0 + i % 2) for i in range(50)] + [("b", f"q{i}", None if i == 4 else 0.5, 2.0) for i in range(7)] + [(None, "q1", 3.0, 1.0)]


@pytest.fixture()
def units(spark):
    return spark.createDataFrame(ROWS, "g string, q string, v double, n double")


@pytest.mark.parametrize("parts", [1, 5])
def test_sums(units, parts):
    got = {(r["g"], r["rep"]): (r["v"], r["n"]) for r in rs.weighted_sums(units.repartition(parts), ["g"], "q", ["v", "n"], 2100).collect()}
    assert len(got) == 3 * 2100
    for g in ("a", "b", None):
        for rep in (0, 1, 7, 1999, 2000, 2099):
            own = [(weight(q, rep), v or 0, n) for x, q, v, n in ROWS if x == g]
            assert got[g, rep] == pytest.approx((sum(w * v for w, v, _ in own), sum(w * n for w, _, n in own)))


def test_signs(units):
    a = units.filter("g = 'a'").withColumn("v", F.col("v") - 1)
    got = rs.sign_test(a, ["g"], "q", "v", 300).first()
    seen = abs(sum(v - 1 for g, _, v, _ in ROWS if g == "a"))
    hits = sum(abs(sum((v - 1) * (1 if bits(q, rep) % 2 == 0 else -1) for g, q, v, _ in ROWS if g == "a")) >= seen for rep in range(300))
    assert (got["n"], got["observed"], got["p"]) == (50, seen, pytest.approx((hits + 1) / 301))


def test_interval(units):
    stats = rs.replicated(units, ["g"], "q", "v", 400, "n")
    got = {r["g"]: (r["low"], r["high"]) for r in rs.ordered_interval(stats, ["g"]).collect()}
    values = sorted(r["v"] for r in stats.filter("g = 'a'").collect())
    assert got["a"] == (values[10], values[390])
    empty = stats.filter("g is null and v is null").count()  # one unit: no weight in a share of 1 / e
    assert 0.25 * 400 < empty < 0.5 * 400 and got[None] == (3.0, 3.0)


def test_weights_are_poisson():
    """Mean and variance of 1, no relation between units or replicates."""
    units = np.array([int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:8], 16) for i in range(800)], dtype=np.uint32)
    w = rs.poisson(rs.mixed(units[None, :], np.arange(2000, dtype=np.uint32)[:, None]))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w[:, :60].T) - np.eye(60)).max() < 0.12 and np.abs(np.corrcoef(w[:60]) - np.eye(60)).max() < 0.2


def test_coverage(spark):
    """The interval of a mean is about that of the normal approximation."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=900)
    units = spark.createDataFrame([("g", str(i), float(v)) for i, v in enumerate(x)], "g string, q string, v double")
    got = rs.ordered_interval(rs.replicated(units, ["g"], "q", "v", 4000), ["g"]).first()
    half = 1.96 * x.std() / 30
    assert got["low"] == pytest.approx(x.mean() - half, abs=0.015) and got["high"] == pytest.approx(x.mean() + half, abs=0.015)


def test_empty(spark):
    none = spark.createDataFrame([], "g string, q string, v double, s double, n double")
    assert rs.replicated(none, ["g"], "q", "v", 100).count() == 0
    assert rs.sign_test(none, ["g"], "q", "v", 100).count() == 0
    assert rs.ratio_interval(none, ["g"], "q", 100).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_sums_of_dense_units(spark, monkeypatch, parts):
    """Spans full of units, by spectra, give the sums of rows of weights."""
    rows = [(g, f"q{i}", float(i % 3) - 0.7, 1.0) for i in range(300) for g in "ab" if i % 5 or g == "a"]
    units = spark.createDataFrame(rows, "g string, q string, v double, n double").repartition(parts)
    monkeypatch.setattr(rs, "DENSE", 0)
    monkeypatch.setattr(rs, "DENSE_MORE", 0)
    for weights, own in ((rs.poisson, weight), (rs.signs, lambda q, rep: 1 - 2 * (bits(q, rep) % 2))):
        got = {(r["g"], r["rep"]): (r["v"], r["n"]) for r in rs.weighted_sums(units, ["g"], "q", ["v", "n"], 300, weights).collect()}
        assert len(got) == 600
        for g in "ab":
            for rep in (0, 1, 17, 299):
                mine = [(own(q, rep), v, n) for x, q, v, n in rows if x == g]
                assert got[g, rep] == pytest.approx((sum(w * v for w, v, _ in mine), sum(w * n for w, _, n in mine)), abs=1e-9)
