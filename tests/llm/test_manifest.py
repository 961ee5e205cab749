"""The manifest against a plain tree over lists."""

import hashlib
import random
import zlib

import pytest
from conftest import SMALL

from tessera.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def around(tree, idx):
    """(left, right) texts of each level's siblings."""
    for level in tree[:-1]:
        run = idx // 3 * 3
        yield "".join(level[run:idx]), "".join(level[idx + 1 : run + 3])
        idx //= 3


def expected(rows):
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r, r[1]) for r in sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        for i, r in enumerate(own):
            beside = [*around(trees[s], i), *around(top, sources.index(s))]
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf(r, text)
            for left, right in beside:
                now = sha(left + now + right)
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in beside)), now, now == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("tasks", [3, 40])
def test_against_lists(spark, tasks, monkeypatch):
    rng = random.Random(5)
    rows = [(i * 7 % 1009, rng.choice(["a\nb", "", None, "é \n" * 9, "plain"]), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "ä", "b", None, ""]), rng.choice([None, i])) for i in range(400)]
    rows += [(2**53 + 1, "x\ny", "en", "one alone", 3), (None, "x\ny", None, "hot", None), (None, None, None, None, None)]
    rows += [(5, "again\n", "en", "hot", 1)] * 30  # repeated rows, over the cut of tasks or not
    rows += [(5, "again", "en", "hot", 1)]
    monkeypatch.setattr(manifest, "partitions", lambda spark: tasks)
    monkeypatch.setattr(manifest, "SPAN", 2)
    monkeypatch.setattr(manifest, "DEPTH", 2)
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'own' as key", "1 as part", "2 as digest", "3 as place", "4 as level")
    assert found(manifest.document_proofs(docs)) == expected(rows)
    monkeypatch.undo()
    assert found(manifest.document_proofs(docs.limit(400).filter("doc_id < 12 or source = 'one alone'"))) == expected([tuple(r)[:5] for r in docs.limit(400).filter("doc_id < 12 or source = 'one alone'").collect()])


def test_sizes(spark):
    """Each number of leaves up to 30, one partition each: short runs at every level."""
    rows = [(i, f"t{i}", None, f"s{n:02}", n) for n in range(1, 31) for i in range(n)]
    assert found(manifest.document_proofs(spark.createDataFrame(rows, DOCS))) == expected(rows)


def test_empty(spark):
    assert manifest.document_proofs(spark.createDataFrame([], DOCS)).count() == 0


def test_nodes(spark):
    """The tree's records: every run's digest is that of its children, every level has as many nodes as it must."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    built = manifest.tree(docs.select("source", "doc_id", manifest.leaf_digest([docs.doc_id, docs.text]).alias("digest")), "source", [docs.doc_id], ["doc_id"], 5)
    runs = built.runs.collect()
    for r in runs:
        children = bytes(r["children"])
        assert bytes(r["digest"]) == manifest.parent([children[i : i + 32] for i in range(0, len(children), 32)])
    for r in built.roots.collect():
        own = [(x["level"], x["idx"]) for x in runs if x["source"] == r["source"]]
        assert len(own) == len(set(own)) == sum(-(-r["n"] // 3**k) for k in range(1, r["height"] + 1))
