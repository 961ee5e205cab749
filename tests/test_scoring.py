"""Scoring, extraction and parsing against hand-made cases and Python's own numbers."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import parsing, scoring


def values(spark, rows, *columns):
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{n} string" for n in names))
    return [tuple(r) for r in df.select(*[c(*[F.col(n) for n in names]).alias(f"v{i}") for i, c in enumerate(columns)]).collect()]


def reference_normal(s):
    """The definition in Python: integers without a point as integers, other numbers by %g."""
    s = s.strip().lower()
    try:
        x = float(s)
    except ValueError:
        return s
    if x != x or x in (float("inf"), float("-inf")):
        return s
    return str(int(x)) if x == int(x) and "." not in s else f"{x:g}"


CASES = ["Yes", " yes ", "55.130", "55.13", "123456.7", "123456.8", "1234567", "1234567.0", "1_000", "1d", "inf", "nan", "", "-0.0", "1e5", "1e-7", "0.0001", "0.00001", ".5", "5.", "+3", "1__0", "12,3", "1e400", "0", "-7", "1e20", "100000.0", "999999.5"]


def test_normal_numbers(spark):
    got = values(spark, [(c,) for c in CASES], scoring.normalized_number)
    assert [g[0] for g in got] == [reference_normal(c) for c in CASES]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=40, max_size=40))
def test_normal_floats(spark, xs):
    texts = [repr(x) for x in xs]
    assert [g[0] for g in values(spark, [(t,) for t in texts], scoring.normalized_number)] == [reference_normal(t) for t in texts]


@pytest.mark.parametrize(("p", "a", "exact", "numeric"), [("Yes", "yes", 1, 0), ("55.130", "55.13", 1, 1), ("123456.7", "123456.8", 1, 1), ("1.0001", "1.0", 0, 1), ("1234567", "1234567.0", 0, 1), ("x", "1", 0, 0), ("100", "101", 0, 1), ("100", "102", 0, 0)])
def test_matches(spark, p, a, exact, numeric):
    assert values(spark, [(p, a)], scoring.exact_match, scoring.numeric_accuracy) == [(exact, numeric)]


@pytest.mark.parametrize(("p", "a", "f1"), [("value is 10", "10", 0.5), ("", "", 1.0), ("", "x", 0.0), ("a a b", "a b b", 2 / 3), ("The, cat!", "the cat", 1.0)])
def test_f1(spark, p, a, f1):
    assert values(spark, [(p, a)], scoring.token_f1)[0][0] == pytest.approx(f1)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Looking closely at the chart that was given, the answer is 42.", "42"),
        ("We look at all the points of this long series.\nAnswer: 55.3", "55.3"),
        ("After looking at every value of the whole series. Therefore, 50", "50"),
        ("The values go up from the left to the right here. Thus, increasing", "increasing"),
        ("Adding up all of the values in the table we get \\boxed{3.14}", "3.14"),
        ("We look at all the points of this long series again.\n**42**", "42"),
        ("We look at all the points of this long series again\n25.0", "25.0"),
        ("We look at all of the points of this long series.\nCompany A", "Company A"),
        ("", ""),
        ("   ", ""),
        ("A" * 100, "A" * 100),
        ("We have added all numbers in the table. Result: 7.5", "7.5"),
        ("This has been found by looking at the chart. Therefore, yes and the model agrees", "yes"),
        ("short", "short"),
    ],
)
def test_extracted(spark, text, want):
    assert values(spark, [(text,)], scoring.extracted) == [(want,)]


@pytest.mark.parametrize(
    ("raw", "task", "want"),
    [
        ("Yes, the graph is connected.", "connectivity", "yes"),
        ("Based on the chart, the degree of node 0 is 3.", "degree_query", "3"),
        ("**42**", "aggregation", "42"),
        ("I cannot determine", "ranking", "[REFUSED]"),
        ("I'm unable to tell", "aggregation", "[REFUSED]"),
        ("The trend is clearly increasing over time", "trend_analysis", "increasing"),
        ("'Company B' has the highest value", "ranking", "Company B"),
        ("no significant change", "change_point", "none"),
        ("0", "connectivity", "no"),
        ("Blue", "other", "blue"),
        ("Sorry, but I counted 7 of them", "connectivity", "7"),
        ("True, they are joined", "boolean_check", "yes"),
        ("They are not directly joined", "connectivity", "no"),
        ("There are between 3 and 12 nodes here", "node_count", "12"),
        ("There are many", "node_count", "there are many"),
        ("First Half is more volatile", "volatility", "first half"),
        ("Hard to say for this one", "volatility", "hard to say for this one"),
        ("The change is at 17", "change_point", "17"),
        ("Somewhere in the middle", "change_point", "Somewhere in"),
        ("Company C was the largest of all", "comparison", "Company C"),
        ("the has of it", "ranking", "the has of it"),
        ("The has of it", "ranking", "The"),
        ("I think that yes holds", "other", "yes"),
        ("We found that all seven of them sum up to 40 points", "other", "40"),
        ("Over all of the years it seems higher", "other", "higher"),
        ("Final answer:   `-3.5`.", "value_lookup", "-3.5"),
        ("", "ranking", ""),
        (" \u2003 ", "other", ""),
        (None, "ranking", None),
        ("7", None, None),
    ],
)
def test_parsed(spark, raw, task, want):
    assert values(spark, [(raw, task)], parsing.parsed) == [(want,)]


def test_token_f1_makes_tokens_once(spark):
    """Multisets against plain counts; each side's tokens stand once in the plan, not in every lambda that counts them."""
    rng = random.Random(8)
    pairs = [(" ".join(rng.choices("abcde", k=rng.randrange(9))), " ".join(rng.choices("abcdef", k=rng.randrange(9)))) for _ in range(200)]
    for (p, a), (got,) in zip(pairs, values(spark, pairs, scoring.token_f1), strict=True):
        x, y = Counter(p.split()), Counter(a.split())
        common = (x & y).total()
        assert got == pytest.approx(1.0 if not x and not y else 2 * common / (x.total() + y.total()))
    df = spark.createDataFrame(pairs, "p string, a string")
    made = lambda c: df.select(c)._jdf.queryExecution().optimizedPlan().toString().count("translate(")
    assert made(scoring.token_f1(F.col("p"), F.col("a"))) == 2 * made(scoring.tokens(F.col("p"))) > 0
