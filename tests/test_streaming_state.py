"""Incremental scoring keeps its keys in the state store."""

import json
import shutil

from tessera.streaming import incremental

SCHEMA = "question_id string, viz_type string, answer string, prediction string, ord long"


def put(folder, name, *rows):
    (folder / name).write_text("".join(json.dumps(dict(zip(["question_id", "viz_type", "answer", "prediction", "ord"], r, strict=True))) + "\n" for r in rows))


def test_restart_and_late_retries(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        query = incremental.score_incrementally(incremental.read_stream(spark, str(source), SCHEMA), str(target), str(tmp_path / "cp"))
        query.awaitTermination()

    def batch(number):
        return sorted(((r["question_id"], r["prediction"], r["exact_match"]) for r in spark.read.parquet(f"{target}/batch={number}").collect()), key=str)

    put(source, "1.json", ("a", "v", "1", "1", 1), ("a", "v", "1", "2", 2), ("a", "v", "1", "[ERROR]", 3), ("b", "v", "1", "[ERROR]", 1), ("b", "v", "1", "[ERROR]", 2), (None, "v", "1", "1", 1))
    run()
    assert batch(0) == sorted([("a", "2", 0.0), ("b", "[ERROR]", 0.0), (None, "1", 1.0)], key=str)
    run()  # nothing new: no batch, nothing again
    assert not (target / "batch=1").exists()
    # a good key's retries stay out, an error's retry goes out until it is good; an error after that stays out
    put(source, "2.json", ("a", "v", "1", "1", 9), ("b", "v", "1", "[ERROR]", 3), ("c", "v", "5", "5.0", 1))
    run()
    assert batch(1) == [("b", "[ERROR]", 0.0), ("c", "5.0", 1.0)]
    put(source, "3.json", ("b", "v", "1", "1", 4))
    run()
    assert batch(2) == [("b", "1", 1.0)]
    # the target isn't read: without it, keys that went out are known all the same
    shutil.rmtree(target)
    put(source, "4.json", ("b", "v", "1", "[ERROR]", 5), ("a", "v", "1", "1", 10), ("d", "v", "1", "1", 1))
    run()
    assert batch(3) == [("d", "1", 1.0)]


def test_batch_runs_again(spark, tmp_path):
    """A batch whose commit was lost is made again from the state before it, to the same rows."""
    source, target, cp = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    source.mkdir()
    run = lambda: incremental.score_incrementally(incremental.read_stream(spark, str(source), SCHEMA), str(target), str(cp)).awaitTermination()
    put(source, "1.json", ("a", "v", "1", "1", 1))
    run()
    put(source, "2.json", ("a", "v", "1", "1", 2), ("b", "v", "1", "3", 1))
    run()
    first = sorted(map(str, spark.read.parquet(str(target)).collect()))
    for name in ("1", ".1.crc"):
        (cp / "commits" / name).unlink()
    run()
    assert sorted(map(str, spark.read.parquet(str(target)).collect())) == first and len(first) == 2
