"""Queries with SQL against it, and the pipeline's stages."""

import corpus_pipeline
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_oracles import same_rows

from tessera.llm import jaccard, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name]))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = stage(spark, docs, SMALL).cache()
        if name == "packing":
            assert {r[0] for r in docs.select("doc_id").distinct().collect()} == ids
            continue
        assert docs.columns == columns and docs.count() <= before
        ids = {r[0] for r in docs.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            again = jaccard.joined(docs, n=5, percent=80)
            assert again.filter("component_id = doc_id").count() == docs.count()
        if name == "secret scans":
            assert docs.count() == before


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, ids that repeat with other texts, columns with the operators' names; empty tables."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(5, words, None, None, 1), (5, f"{words} more", "en", "s", 2), (3, f"{words} more of", "en", "s", 3), (None, f"x {words}", "en", None, None), (7, None, None, "s", 0), (7, None, None, "s", 0), (8, "", "en", "s", 0), (9, "alone it stands. password = abcdEFGH1234", "en", "s", 9), (9, "alone it stands. password = abcdEFGH1234", "en", "s", 9)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashing = ["keep", "score", "predicted", "held_out", "kept", "row", "blob", "spans", "component_id", "host_rate"]
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in clashing])
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = out.count()
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in clashing)
        if name != "n-gram Jaccard join":
            assert out.count() == before
    left = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert left == sorted([(3, f"{words} more of"), (7, None), (8, ""), (9, "alone it stands. [SECRET]")], key=str)
    assert corpus_pipeline.pack(spark, out, str(tmp_path)).select("doc_id").distinct().count() == 4
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
