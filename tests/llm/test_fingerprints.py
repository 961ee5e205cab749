"""Fingerprints against sets of phrases that are kept whole."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SMALL

from tessera.llm import fingerprints

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def parsed(text):
    """The set of phrases, as byte strings."""
    seen, start, data = set(), 0, text.encode()
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            start = end
    return seen


def jaccard(a, b):
    a, b = parsed(a), parsed(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows):
    got = sorted(fingerprints.edited(spark.createDataFrame(rows, DOCS).selectExpr("*", "'own' as key", "1 as task", "2 as kind")).collect(), key=str)
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in got]
    assert sorted(ids, key=str) == sorted((r[0] for r in rows), key=str)
    if len(set(ids)) == len(ids):  # without repeated ids the next row is plain
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
        by = {r["doc_id"]: r for r in got}
        for i, r in enumerate(order):
            text, beside = r[1] or "", order[(i + 1) % len(order)][1] or ""
            third = len(text) // 3
            edit = text[: len(text) - third] + beside[:third]
            row = by[r[0]]
            assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
            assert row["fingerprint"] == fingerprints._text(fingerprints.fingerprint(text)) and row["edited_fingerprint"] == fingerprints._text(fingerprints.fingerprint(edit))
            for name, other in (("near_edited", edit), ("near_next", beside)):
                want = jaccard(text, other)
                small = max(len(parsed(text)), len(parsed(other))) < fingerprints.SIZE
                assert row[name] == pytest.approx(want, abs=1e-12 if small else 0.2)
    return got


def test_rows(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "ÜBER", "日本語", "x", "alpha\n", "\x01"])
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 30, 400]))), "en", "s", 1) for i in range(60)]
    rows += [(2**53 + 1, None, None, None, None), (2**53 + 2, "", None, None, None), (None, "none " * 20, None, None, None)]
    check(spark, rows)
    again = check(spark, rows + [(5, "again and again " * 9, "en", "s", 1)] * 20 + [(5, "other", "en", "s", 1), (None, None, None, None, None)])
    by = {}
    for r in again:
        if r["n_chars"] == 144:
            by.setdefault(r["fingerprint"], set()).add(r["edited_sha256"])
    assert len(by) == 1  # equal texts have equal fingerprints
    check(spark, rows[:1])
    check(spark, rows[:2])
    assert fingerprints.edited(spark.createDataFrame([], DOCS)).count() == 0


def test_documents(spark):
    """Every document of the table; edited texts are nearer than the next ones, equal ones have 1."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = check(spark, docs)
    assert sum(r["near_edited"] > r["near_next"] for r in got) > 0.9 * len(got)


def test_estimates():
    """The estimate of 128 hashes is unbiased within its error, and exact for small sets."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    off = []
    for share in (0.1, 0.5, 0.9):
        for _ in range(20):
            a = " ".join(rng.choices(words, k=600))
            b = a[: int(len(a) * share)] + " ".join(rng.choices(words, k=200))
            off.append(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) - jaccard(a, b))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_take_back():
    parse = fingerprints.Parse()
    parse.add(b"abcabcabcabd")
    mark, before = parse.mark(), parse.fingerprint().tolist()
    parse.add(b"something else")
    parse.back(mark)
    assert parse.fingerprint().tolist() == before
    parse.add(b"tail")
    assert parse.fingerprint().tolist() == fingerprints.fingerprint("abcabcabcabdtail").tolist()


def test_long_text(spark):
    """A text of two million characters among short ones."""
    rng = random.Random(6)
    long = "".join(rng.choice("abcde ") for _ in range(2_000_000))
    got = fingerprints.fingerprints(spark.createDataFrame([(1, long), (2, long[:1_900_000]), (3, "short")], "doc_id long, text string")).collect()
    marks = {r["doc_id"]: fingerprints._hashes(r["fingerprint"]) for r in got}
    assert fingerprints.likeness(marks[1], marks[2]) > 0.8 and fingerprints.likeness(marks[1], marks[3]) < 0.1


def test_hot_key(spark, monkeypatch):
    """A key, and none, that hold a third of all rows each are split by hash; the order goes on over buckets."""
    monkeypatch.setattr(fingerprints, "partitions", lambda spark: 7)
    rows = [(None if i % 3 == 0 else 40 if i % 3 == 1 else i, f"text {i * 7919 % 50} " * (i % 5), None, None, None) for i in range(240)]
    df = spark.createDataFrame(rows, DOCS)
    order = [tuple(r) for r in df.selectExpr("doc_id", "xxhash64(coalesce(text, '')) as h", "text").collect()]
    order.sort(key=lambda r: r[2])
    order.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = []
    for i, (key, _, text) in enumerate(order):
        beside, third = order[(i + 1) % len(order)][2], len(text) // 3
        want.append((key, hashlib.sha256((text[: len(text) - third] + beside[:third]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in fingerprints.edited(df).collect()), key=str) == sorted(want, key=str)
    buckets = fingerprints._bucketed(df.selectExpr("doc_id as place", "coalesce(text, '') as text"), 7).groupBy("bucket").count().collect()
    assert max(r["count"] for r in buckets) < 80
