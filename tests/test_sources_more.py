"""Generators, models, files and samples that SQL doesn't cover."""

import struct
from collections import Counter

import pytest
from conftest import SMALL

from tessera.functions import formats, models
from tessera.operators import sampling
from tessera.operators.dedupe import last_good
from tessera.plans import QUERIES
from tessera.sources import files


def test_models(spark):
    items = spark.createDataFrame([(1, "what is three"), (2, None), (3, "fail now")], "id long, question string")

    @models.register("picky")
    class Picky:
        def __init__(self, word):
            self.word = word

        def answer(self, prompt):
            if prompt.startswith(self.word):
                raise ValueError(prompt)
            return prompt[-3:]

    assert {r["id"]: r["prediction"] for r in models.predicted(items, {"name": "echo", "prefix": ">", "unused": 1}).collect()} == {1: ">three", 2: ">", 3: ">now"}
    assert models.answer_batch(models.make({"name": "picky", "word": "x"}), ["abcd", "y"]) == ["bcd", "y"]
    with pytest.raises(KeyError):
        models.make({"name": "nothing"})
    assert models.predicted(items.limit(0), {"name": "echo"}).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# all\nmodel:\n  name: echo # a stub\n  batch: 8\n  rate: 0.5\nquick: true\nnone: ~\n")
    assert files.read_config(str(tmp_path / "c.yaml")) == {"model": {"name": "echo", "batch": 8, "rate": 0.5}, "quick": True, "none": None}
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480))
    (tmp_path / "b.png").write_bytes(b"none")
    assert {r["path"][-5:]: (r["width"], r["height"]) for r in files.png_sizes(spark, str(tmp_path)).collect()} == {"a.png": (640, 480), "b.png": (None, None)}
    for name, text in (("x", "id,rating\n1,c\n"), ("y", "id,rating,note\n1,i,z\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = files.assembled_ratings(spark, {n: str(tmp_path / f"{n}.csv") for n in "xy"}).collect()
    assert {(r["evaluator"], r["rating"], r["note"]) for r in got} == {("x", "c", None), ("y", "i", "z")}
    rows = spark.createDataFrame([(2, None), (1, "b")], "id long, v string")
    files.write_items(rows, str(tmp_path / "items"), ["id", "v"])
    assert spark.read.json(str(tmp_path / "items")).count() == 2
    assert [tuple(r) for r in files.bundle({"t": rows}).collect()] == [("t", '[{"id":1,"v":"b"},{"id":2}]')]


def test_deficit_sample(spark):
    got = QUERIES["deficit_sample"](spark, SMALL).collect()
    assert len(got) == 100 == len({r["question_id"] for r in got})
    strata = Counter((r["modality"], r["difficulty"], r["source"]) for r in got)
    sizes = Counter(r["modality"] for r in got)
    assert max(sizes.values()) <= 40 and len(strata) >= 20
    few = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "k string, s string")
    assert sampling.deficit_sample(few, {"s": ("x", "y")}, "k", 2, 1).select("s").distinct().count() == 2


def test_rating_fails(spark):
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="unknown rating"):
        spark.createDataFrame([("z",)], "r string").select(formats.rating(F.col("r"))).collect()


def test_null_prediction_is_kept(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, "[ERROR]", 2), (2, "[ERROR]", 1)], "k long, prediction string, ord long")
    assert [(r["k"], r["prediction"]) for r in last_good(rows, ["k"], ["ord"]).collect()] == [(1, None)]
