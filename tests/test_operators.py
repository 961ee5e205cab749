"""Operators on small hand-made frames: nulls, ties, repeats, empty inputs."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions import paraphrase
from tessera.operators import aggregate, dedupe, graph, statistics
from tessera.sources import files
from tessera.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_last_good(spark):
    df = spark.createDataFrame([("q", "v", 1, "a"), ("q", "v", 2, "[ERROR]"), ("r", "v", 1, "[ERROR]")], "question_id string, viz_type string, ord int, prediction string")
    key = ["question_id", "viz_type"]
    assert rows(dedupe.last_good(df, key, ["ord"])) == [("q", "v", 1, "a")]
    assert rows(dedupe.last_good(df, key, ["ord"], keep_only_errors=True)) == [("q", "v", 1, "a"), ("r", "v", 1, "[ERROR]")]
    assert dedupe.last_good(df.limit(0), key, ["ord"]).count() == 0


def test_ties(spark):
    df = spark.createDataFrame([("m", "b", 1.0), ("m", "a", 1.0), ("m", "c", 0.0), ("m", "ab", 0.0)], "model string, viz string, em double")
    assert rows(aggregate.best_and_worst(df, ["model"], "viz", "em")) == [("m", "a", "ab", 1.0, 0.0, 1.0)]
    assert rows(aggregate.best_and_worst(df, ["model"], "viz", "em", ties="last"))[0][1:3] == ("b", "c")


def test_disagreement_is_all_pairs(spark):
    values = ["a", "b", "a", "c", "c", "c"]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v string")
    pairs = list(itertools.combinations(values, 2))
    assert rows(aggregate.disagreement(df, ["k"], "v")) == [("k", 6, len(pairs), sum(a != b for a, b in pairs))]


def test_kappa(spark):
    df = spark.createDataFrame([("x", "x")] * 4 + [("x", "y")] * 2 + [("y", "y")] * 4, "a string, b string")
    (n, agreement, kappa) = rows(statistics.cohen_kappa(df, [], "a", "b"))[0]
    assert (n, agreement) == (10, 0.8)
    assert kappa == pytest.approx((0.8 - 0.48) / 0.52)
    assert rows(statistics.cohen_kappa(df.filter("a = b and a = 'x'"), [], "a", "b"))[0][2] == 1.0


def test_spearman(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0)], "x double, y double")
    assert rows(statistics.spearman(df, [], "x", "y")) == [(1.0, 3)]


def test_quotas(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "k string, n int")
    assert [r[2] for r in rows(statistics.quotas(df, "n", 10, ["k"]))] == [5, 4, 1]


def test_graph_summary(spark):
    nodes = spark.createDataFrame([(1, n) for n in range(6)] + [(2, n) for n in range(5)], "data_id long, node long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2), (1, 3, 4)] + [(2, i, i + 1) for i in range(4)] + [(2, 0, 4)], "data_id long, src long, dst long")
    out = {r["data_id"]: r for r in graph.summaries(nodes, edges).collect()}
    assert (out[1]["components"], out[1]["largest"], out[1]["diameter"], out[1]["bipartite"], out[1]["cyclic"]) == (3, 3, 1, False, True)
    assert (out[2]["components"], out[2]["diameter"], out[2]["bipartite"], out[2]["cyclic"]) == (1, 2, False, True)
    assert {r["node"]: r["component"] for r in graph.labels(nodes, edges).filter("data_id = 1").collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_paraphrase(spark):
    df = spark.createDataFrame([("q1", "What is the maximum of node 3?"), ("q2", "")], "question_id string, question string")
    out = rows(paraphrase.with_variants(df, 3))
    assert [r[0] for r in out] == ["q1", "q1_para0", "q1_para1", "q1_para2", "q2"]
    assert out[1][1] == "Determine the maximum of node 3?"
    assert out[1][2] == "q1"
    assert spark.createDataFrame([("[BOLD] 1,234.5%",)], "x string").select(paraphrase.coerced(F.col("x"))).first()[0] == 1234.5
    assert spark.createDataFrame([("-",)], "x string").select(paraphrase.coerced(F.col("x"))).first()[0] is None


def test_files(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"question_id": "q", "prediction": "1"}\n\nnot json\n{"question_id": "r"}\n')
    good, bad = files.read_tolerant(spark, str(path), "question_id string, prediction string")
    assert rows(good.fillna("")) == [("q", "1"), ("r", "")] and bad == 1
    assert files.read_jsonl(spark, str(tmp_path / "none"), "x string").count() == 0
    with pytest.raises(ValueError, match="no rows"):
        files.read_checked(spark, str(tmp_path / "none"), "x string")
    ids = tmp_path / "ids.txt"
    ids.write_text("a b\n c")
    assert rows(files.read_ids(spark, str(ids))) == [("a",), ("b",), ("c",)]
    sheet = tmp_path / "wide.csv"
    sheet.write_text("item_id,ann,bob\n1,Correct,incorrect\n2,,ambiguous\n")
    assert rows(files.read_ratings(spark, str(sheet))) == [("1", "ann", "c"), ("1", "bob", "i"), ("2", "bob", "a")]
    image = tmp_path / "tab_1_bar_chart.png"
    image.write_bytes(b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    assert [(r[0], r[1], r[3], r[4]) for r in files.image_index(spark, str(tmp_path)).collect()] == [("tab_1", "bar_chart", 640, 480)]


def test_claims(spark, tmp_path):
    path = tmp_path / "claims.json"
    path.write_text('[{"id": "1", "claim": "c", "human_label": "yes", "table_id": "t", "table_column_names": ["[BOLD] A", "B"], "table_content_values": [["x", "1,000"], ["y"]]}]')
    claims = files.read_claims(spark, str(path))
    assert claims.first()["label"] == "yes"
    cells = {(r["row_idx"], r["col_name"]): (r["num_value"], r["str_value"]) for r in files.table_cells(claims).collect()}
    assert cells == {(0, "A"): (None, "x"), (0, "B"): (1000.0, "1,000"), (1, "A"): (None, "y"), (1, "B"): (None, "")}


def test_reports(spark):
    df = spark.createDataFrame([("a_b", 1.0)], "name string, v double")
    assert files.markdown(df, ["name", "v"]).splitlines()[-1] == "| a_b | 1.00 |"
    assert r"a\_b & 1.00 \\" in files.latex(df, ["name", "v"])


def test_incremental(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "question_id string, viz_type string, answer string, prediction string, ord long"
    (source / "1.json").write_text('{"question_id":"q","viz_type":"v","answer":"1","prediction":"[ERROR]","ord":1}\n{"question_id":"r","viz_type":"v","answer":"2","prediction":"2.0","ord":1}\n')
    run = lambda: incremental.score_incrementally(incremental.read_stream(spark, str(source), schema), target, str(tmp_path / "cp")).awaitTermination()
    run()
    (source / "2.json").write_text('{"question_id":"q","viz_type":"v","answer":"1","prediction":"1","ord":2}\n{"question_id":"r","viz_type":"v","answer":"2","prediction":"9","ord":2}\n')
    run()
    good = spark.read.parquet(target).filter("prediction <> '[ERROR]'")
    assert rows(good.select("question_id", "prediction", "exact_match", "numeric_accuracy")) == [("q", "1", 1.0, 1.0), ("r", "2.0", 1.0, 1.0)]


def test_every_table_meets_every_graph(spark):
    from conftest import SMALL

    from tessera import plans

    brands = spark.read.parquet(f"{SMALL}/part.parquet").select("p_brand").distinct().count()
    got = plans.QUERIES["mixed_table_graph"](spark, SMALL).collect()
    assert len(got) == len({(r["table_id"], r["graph_id"]) for r in got}) == 7 * brands


def test_bounds_are_errors(spark):
    nodes = spark.range(6).selectExpr("1L as data_id", "id as node")
    edges = spark.range(5).selectExpr("1L as data_id", "id as src", "id + 1 as dst")
    assert sorted(tuple(r) for r in graph.distances(nodes, edges, source=0).collect()) == [(1, i, i) for i in range(6)]
    with pytest.raises(RuntimeError):
        graph.distances(nodes, edges, source=0, rounds=3)
    with pytest.raises(RuntimeError):
        graph.labels(nodes, edges, rounds=1)
    with pytest.raises(ValueError):
        files.markdown(spark.range(10_001), ["id"])


def test_ensembles_count_patterns(spark):
    """Questions alike in formats, scores and equal predictions are drawn once: what is exploded by draws does not grow with the questions."""
    from conftest import SMALL

    from tessera.plans.statistics import ensemble_accuracy

    plan = ensemble_accuracy(spark, SMALL, 5, 12)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("explode(") :]
    assert "Aggregate" in below and "pattern" in below
