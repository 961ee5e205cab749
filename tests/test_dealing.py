"""Rows of a task are bounded, whatever the input."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import dealing, dedupe, graph
from tessera.operators import statistics as st
from tessera.plans import ORACLES, QUERIES, items
from tessera.sources import adapters
from tests.conftest import SMALL


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(dealing, "TASK_ROWS", 500)


def exchanges(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_dealt(spark, few):
    rows = spark.range(3000)
    assert dealing.dealt(rows, 3000, "id").rdd.getNumPartitions() == 6
    assert max(len(p) for p in dealing.dealt(rows, 3000, "id").rdd.glom().collect()) < 700


def same(spark, duck, name):
    got = [tuple(r) for r in QUERIES[name](spark, SMALL).collect()]
    assert sorted(got) == sorted(duck.sql(ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", ["flip_pairs", "consistency_rate"])
def test_questions_stay_in_their_task(spark, duck, few, name):
    """Questions are grouped where their orders are: no exchange by text, tasks as many as rows need."""
    found = exchanges(QUERIES[name](spark, SMALL))
    assert not any("question_id" in x or "order_key" in x or "prediction" in x for x in found)
    assert adapters.facts_by_order(spark, SMALL).rdd.getNumPartitions() >= 12
    same(spark, duck, name)


def test_keys_of_one_side(spark, duck, few):
    """One pass over the lines, no text in an exchange; a side without keys of its own counts 0; null keys are equal, as in EXCEPT."""
    assert not any("question_id" in x or "modality" in x for x in exchanges(QUERIES["key_difference"](spark, SMALL)))
    same(spark, duck, "key_difference")
    rows = spark.createDataFrame([("A", 1, "x"), ("N", 1, "x"), ("A", 2, None), ("N", 2, None), ("A", 3, None), ("A", 3, None), (None, 4, "y")], "s string, k long, v string")
    assert [tuple(r) for r in dedupe.key_difference(rows, rows.s == "A", rows.s == "N", ["k", "v"]).collect()] == [(3, None, "missing")]


def test_no_keys_of_one_side(spark, tmp_path):
    for name in ("lineitem", "orders"):
        rows = adapters.read(spark, SMALL, name)
        (rows.filter("l_returnflag = 'A'") if name == "lineitem" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    got = dict(QUERIES["key_difference"](spark, str(tmp_path)).collect())
    assert got["extra"] == 0 < got["missing"]


@pytest.mark.parametrize("most", [1000, 6])
def test_projection_is_dealt_by_pairs(spark, few, most):
    rng = random.Random(5)
    rows = list({(rng.randrange(60), rng.randrange(90)) for _ in range(900)})
    out = graph.projected(spark.createDataFrame(rows, "e long, m long"), "e", "m", most)
    want: dict = {}
    for e, a in rows:
        for f, b in rows:
            if e == f and a < b:
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["weight"] for r in out.collect()} == want
    assert sum(want.values()) > 5000 and out.rdd.getNumPartitions() >= 10
    assert not any("Join" in line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if most == 1000)


def test_ensemble(spark, duck, few):
    """One grouping where the facts are, no join; against a plain count."""
    found = exchanges(QUERIES["format_ensemble"](spark, SMALL))
    assert not any("question_id" in x or "order_key" in x for x in found)
    same(spark, duck, "format_ensemble")
    rng = random.Random(6)
    rows = [(k, v, o, s) for k in range(40) for o in range(rng.randrange(1, 8)) for v, s in [(rng.choice("xyz"), rng.choice([0.0, 1.0]))]]
    got = {r["k"]: tuple(r)[1:] for r in st.ensemble(spark.createDataFrame(rows, "k int, v string, o int, s double"), ["k"], F.col("v"), "o", "s").collect()}
    for k in range(40):
        own = [r for r in rows if r[0] == k]
        best = min({r[1] for r in own}, key=lambda v: (-sum(r[1] == v for r in own), min(r[2] for r in own if r[1] == v)))
        s = [r[3] for r in own]
        assert got[k] == (float(max(r[3] for r in own if r[1] == best) >= 0.5), sum(s) / len(s), max(s), min(s))


@pytest.mark.parametrize("sent", [8_000_000, 0])
def test_texts_are_scored_once(spark, duck, few, monkeypatch, sent):
    """No question's name in an exchange: guesses go by text, sent to the facts or joined by a shuffle."""
    monkeypatch.setattr(items, "BROADCAST_TEXTS", sent)
    found = exchanges(QUERIES["classified_selector"](spark, SMALL))
    assert not any("question_id" in x for x in found) and any("question#" in x for x in found) == (not sent)
    same(spark, duck, "classified_selector")
