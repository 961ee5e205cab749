"""Collocations against a plain count."""

import random
import re
from collections import Counter

from tessera.llm import collocations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def expected(rows, least=30, longest=4, top=2000, held=80):
    counts, sizes = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    counts = {k: a for k, a in counts.items() if a >= least}
    dropped = set()
    for (lang, words), a in counts.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * a >= held * counts[lang, words[i : i + k]]:
                    dropped.add((lang, words[i : i + k]))
    out = []
    for lang in sizes:
        own = []
        for (x, words), a in counts.items():
            if x == lang and len(words) > 1 and (x, words) not in dropped:
                score, _, le, ri = min((2000000 * a // (counts[x, words[:k]] + counts[x, words[k:]]), k, counts[x, words[:k]], counts[x, words[k:]]) for k in range(1, len(words)))
                own.append((-score, -a, " ".join(words).encode(), le, ri))
        out += [(lang, i + 1, p.decode(), -a, le, ri, sizes[lang], -s) for i, (s, a, p, le, ri) in enumerate(sorted(own)[:top])]
    return sorted(out)


def random_rows(seed, n=2500):
    rng = random.Random(seed)
    words = ["The", "the", "of", "ÉTÉ", "été", "a-b", "x\x01y", "it's", "日本", "~", "and"]
    pieces = [" ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!?", " ", " ", "\xa0", " "]
    return [(i, "".join(rng.choice(words) + rng.choice(pieces) for _ in range(rng.randrange(60))) if rng.random() > 0.05 else None, rng.choice(["en", "en", "en", "fr", None, "und", ""]), "s", 1) for i in range(n)]


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_against_counts(spark):
    rows = random_rows(1) + [(9, "over and over and over and over", "en", None, None)] * 40
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'own' as word", "1 as a", "2 as found", "3 as id", "4 as block")
    want = expected(rows)
    assert found(collocations.collocations(docs)) == want and len(want) > 50
    # many small blocks, a map of bits so small that it lets most phrases through, few kept a language
    assert found(collocations.collocations(docs, places=500, room=1 << 15)) == want
    assert found(collocations.collocations(docs, least=2, longest=3, top=25, held=60)) == expected(rows, 2, 3, 25, 60)


def test_edges(spark):
    """No rows, no words, one word, a phrase that is found just often enough, one long text."""
    none = spark.createDataFrame([], DOCS)
    assert found(collocations.collocations(none)) == []
    rows = [(1, None, "en", None, None), (2, " \t\n.;", None, None, None), (3, "one", "en", None, None)]
    assert found(collocations.collocations(spark.createDataFrame(rows, DOCS))) == []
    for times in (29, 30):
        rows = [(1, "new york. " * times, "en", None, None)]
        assert found(collocations.collocations(spark.createDataFrame(rows, DOCS))) == expected(rows)
    rows = [(1, "a b c d e f " * 40_000, "en", None, None)]
    assert found(collocations.collocations(spark.createDataFrame(rows, DOCS))) == expected(rows)


def test_lists(spark):
    """Every list's places are ascending, its length is the word's count, pieces don't touch."""
    rows = [("en", "b a b. a\tB"), ("fr", "a"), ("en", "b")]
    lists = collocations.postings(spark.createDataFrame(rows, "lang string, text string").coalesce(1)).collect()
    places = {}
    for r in lists:
        every = [int.from_bytes(r["places"][i : i + 4], "little") for i in range(0, len(r["places"]), 4)]
        for word, n in zip(r["words"], r["counts"], strict=True):
            places[r["lang"], word], every = every[:n], every[n:]
        assert not every
    assert places == {("en", "b"): [0, 2, 5, 7], ("en", "a"): [1, 4], ("fr", "a"): [0]}


def test_packed_counts():
    """Phrases of several blocks come back whole, equal ones as one, in few bytes a row; none at all too."""
    import numpy as np

    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 40_000, 100_000), rng.integers(0, 40_000, 100_000), rng.integers(1, 3, 100_000)]
    want = Counter()
    for a, b, n in zip(*(c.tolist() for c in columns), strict=True):
        want[a, b] += n
    packs = collocations._packs([np.concatenate([c, c[:50]]) for c in columns], 4).to_pylist()
    want.update({(a, b): 0 for a, b in want})
    for a, b, n in zip(*(c[:50].tolist() for c in columns), strict=True):
        want[a, b] += n
    got = np.concatenate([collocations._unpack(p["packed"], 3) for p in packs], axis=1)
    assert dict(zip(zip(got[0].tolist(), got[1].tolist(), strict=True), got[2].tolist(), strict=True)) == want
    assert sum(len(p["packed"]) for p in packs) < 8 * len(want)
    large = [np.array([5, 2**40, 2**62]), np.array([1, -(2**40), 7]), np.array([1, 2, 3])]
    assert [c.tolist() for c in collocations._unpack(collocations._pack(large), 3)] == [c.tolist() for c in large]
    assert [len(c) for c in collocations._unpack(collocations._pack([c[:0] for c in large]), 3)] == [0, 0, 0]
