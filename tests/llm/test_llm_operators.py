"""Operators against brute force, round trips and edge cases."""

import hashlib
import itertools
import random
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as vocabularies
import pytest
import tiktoken
from conftest import SMALL
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, html_main, jaccard, packing, quality, queries, secrets, tokens, topk, toxicity, vector_dedup
from tessera.llm.components import components

LARGE = 2**53 + 1
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "two words", "x  y \n\n z", "ünï çode ñandú 12 34", "it's we'll \t x", "a b　c", "z" * 300, "<|endoftext|> <|im_end|>", "\x01\x02\x03 odd"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def encoder():
    ranks = tokens.encoder(queries.RANKS, vocabularies.PATTERN)[0]._mergeable_ranks
    return tiktoken.Encoding("plain", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, encoder):
    texts = [*ODD, *[r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(40).collect()]]
    docs = documents(spark, texts)
    vocabulary = bpe.Vocabulary(spark, queries.RANKS, vocabularies.PATTERN)
    for learned in (False, True):
        if learned:
            vocabulary.learn_dictionary(docs)
        for r in bpe.round_trip(docs, vocabulary).collect():
            want = encoder.encode_ordinary(texts[r["doc_id"]] or "")
            assert (r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) == (len(want), np.array(want, dtype="<u4").tobytes(), (texts[r["doc_id"]] or "").encode())
    assert bpe.round_trip(docs.limit(0), vocabulary).count() == 0


def test_remembered_tokens(encoder):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice([" ", "\n", "ab", "é", "1", ".", ",", "'s", "Ü", "\t", " the", "word"]) for _ in range(rng.randrange(20)))
        assert np.frombuffer(tokens.ids(text, queries.RANKS, vocabularies.PATTERN), "<u4").tolist() == encoder.encode_ordinary(text)


def test_chat(spark):
    rows = [(1, 0, "system", "be kind \\ <|im_end|>"), (1, 1, "user", "hi"), (1, 2, "assistant", "long " * 60), (1, 3, "user", None), (1, 4, "assistant", "ok\n<|im_start|>x\\|"), (1, 4, "assistant", "ok\n<|im_start|>x\\|"), (2, 0, "us\ner", "a" * 900), (None, 0, None, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.windows(df, budget=90, history=2, history_tokens=20)
    kept = windows.collect()
    assert len(kept) > 4
    for w in kept:
        if w["n_tokens"] > 90:  # a turn that is longer by itself
            assert len(chat.parsed(w["text"])) - w["n_repeated"] == 1
    got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    for conv in (1, 2, None):
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == sum(len(w["text"]) for w in kept if w["conv_id"] == conv)
    assert chat.digests(chat.windows(df.limit(0))).count() == 0


def brute_components(links, nodes):
    least = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    named = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: c for n, c in brute_components(links, {n for pair in links for n in pair}).items() if n in named}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(rng):
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 90))]
        for _ in range(rng.randrange(1, 30)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{' '.join(f'u{rng.randrange(9999)}' for _ in range(rng.randrange(1, 40)))} {passage}" for _ in range(40)]
    return texts


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, monkeypatch, n, percent):
    texts = [*near_copies(random.Random(n)), *ODD, None, "A a A a"]
    monkeypatch.setattr(jaccard, "LEAST_COUNT", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROUTES", 0 if n == 5 else 10**6)
    sets = [set(jaccard.shingles(t or "", n).tolist()) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = brute_components(links, range(len(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(documents(spark, texts).repartition(3), n, percent).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in want}
    assert len(links) > 100
    assert jaccard.joined(documents(spark, texts).limit(0), n, percent).count() == 0


@pytest.mark.parametrize(("group", "grams"), [(1000, 10**6), (7, 10**6), (1000, 300)])
def test_jaccard_groups(spark, monkeypatch, group, grams):
    """A large group of near copies, most pairs of which don't link, over many small tasks."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(150):
        copy = base[: 40 + k % 20]
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(99999)}"
        texts.append(" ".join(copy))
    sets = [set(jaccard.shingles(t, 4).tolist()) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "GROUP_GRAMS", grams)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    monkeypatch.setattr(jaccard, "SHORT_LIST", 5)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(documents(spark, texts)).collect()}
    assert got == brute_components(links, range(len(texts)))
    assert 5 < len(set(got.values())) < 130


def test_jaccard_sends_what_may_link(spark, monkeypatch):
    """Sets of a long list that share little else aren't sent to a task, nor are texts of documents without a candidate moved."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{' '.join(f'u{rng.randrange(10**9)}' for _ in range(300 + i))} {passage}" for i in range(60)]
    texts += [f"{texts[k]} end" for k in range(3)]
    texts += [" ".join(f"v{rng.randrange(10**9)}" for _ in range(50)) for _ in range(100)]
    sent = []
    dealt = jaccard._dealt
    monkeypatch.setattr(jaccard, "FREQUENT", 0)
    monkeypatch.setattr(jaccard, "_dealt", lambda *a: sent.append(dealt(*a)) or sent[0])
    docs = documents(spark, texts)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(docs).collect()}
    assert got == {i: i - 60 if 60 <= i < 63 else i for i in range(len(texts))}
    assert {r["name"] for r in sent[0].collect()} == {f"id {i}" for i in (0, 1, 2, 60, 61, 62)}
    named = docs.selectExpr("concat('id ', doc_id) as name", "text")
    moved = {r["name"] for r in jaccard._named(named, sent[0]).collect()}
    assert {f"id {i}" for i in (0, 1, 2, 60, 61, 62)} <= moved and len(moved) < 12


@pytest.mark.parametrize("percent", [60, 85])
def test_outlines(percent):
    """No set that links is left out for its outline, nor beside one without; sets that have nothing in common are."""
    rng = np.random.default_rng(percent)
    hashes = lambda k: rng.integers(0, 2**64, k, dtype="u8")
    told = lambda sets, lines: jaccard.may_link(np.array([len(x) for x in sets]), lines, percent)
    linked = 0
    for _ in range(60):
        bases = [hashes(int(rng.integers(1, 700))) for _ in range(3)]
        sets = [np.unique(np.r_[base[rng.random(len(base)) > rng.choice([0, 0.03, 0.1, 0.3])], base[:1], hashes(int(len(base) * rng.choice([0, 0.05, 0.2])))]) for base in bases * 8]
        may = told(sets, [jaccard.outline(x) if rng.random() > 0.02 else None for x in sets])
        for a, b in itertools.combinations(range(len(sets)), 2):
            if jaccard.links(sets[a], sets[b], percent):
                linked += 1
                assert may[a] and may[b]
    assert linked > 500
    apart = [np.unique(hashes(k)) for k in (20, 21, 400, 410, 1_020, 1_030, 9_000, 9_100)]
    assert percent < 80 or not told(apart, [jaccard.outline(x) for x in apart]).any()
    same = np.arange(2**12, dtype="u8")  # all in one range of hashes
    assert jaccard.outline(same) is None
    assert told([same, same[1:]], [None, None]).all() and not told([same], [None]).any()


def test_jaccard_without_ids(spark):
    """Documents without an id meet by their texts, not each other: as many again take about as long again."""
    rng = random.Random(3)
    rows = []
    for i in range(1_500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(None, " ".join(words)), (None, " ".join([*words, "more"]))]
    rows += [(7, rows[0][1] + " end"), (8, rows[0][1] + " end")]
    began = time.perf_counter()
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert time.perf_counter() - began < 90
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0)] * 2_998 + [(0, 7)] * 2 + [(7, 7), (8, 7)]


def test_jaccard_ids(spark):
    """Ids keep every bit beside a null id."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(LARGE, text), (LARGE + 2, text + " more"), (None, "other words stand here"), (None, "other words stand here")]
    got = sorted((tuple(r) for r in jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()), key=str)
    assert got == sorted([(LARGE, 27, LARGE), (LARGE + 2, 28, LARGE), (None, 1, None), (None, 1, None)], key=str)


def test_shingles():
    assert len(jaccard.shingles("A b\tc D\x0bd", 4)) == 2
    assert jaccard.shingles("Ä b", 4).tolist() != jaccard.shingles("ä b", 4).tolist()
    assert jaccard.shingles("one TWO", 4).tolist() == jaccard.shingles(" one\ntwo ", 4).tolist()


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.scored(docs, toxicity.fit(docs, labels))
    held = [tuple(r) for r in scored.filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " moro": 2.0}, (" moro bay ",))
    assert toxicity.folded("1d10t! іdiot i.d.i.o.t ID­IOT") == " idiot idiot idiot idiot "
    assert lexicon.evidence("morons") > 0 == lexicon.evidence("moro bay")
    assert lexicon.evidence("") == 0 and 0 <= lexicon.score("idiot " * 9999) <= 1
    odd = toxicity.scored(documents(spark, ODD), lexicon)
    assert odd.filter("score between 0 and 1").count() == len(ODD)
    assert toxicity.fit(documents(spark, ODD), labels.limit(0)).weights == {}
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0
    twice = toxicity.scored(docs.limit(5).union(docs.limit(5)).withColumn("score", F.lit("clash")), lexicon)
    assert twice.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("score").alias("k")).filter("n = 2 and k = 1").count() == 5


def test_toxicity_brute_force():
    """Matches, exceptions and weights against a plain scan of every place."""
    rng = random.Random(1)
    lexicon = toxicity.Lexicon({" ab": 1.5, " abc ": 2.5, " abcd": 4.0, " b ": 1.0}, (" abz ", " b abc ", " abcde "))
    for _ in range(400):
        words = [rng.choice(["ab", "abc", "abz", "abcd", "abcde", "b", "c", "abq"]) for _ in range(rng.randrange(12))]
        text = toxicity.folded(" ".join(words))
        total = 0.0
        for start in range(len(text)):
            terms = [t for t in lexicon.weights if text.startswith(t, start)]
            spared = any(text.startswith(p, at) and at <= start < at + len(p) - 1 for p in lexicon.exceptions for at in range(start + 1))
            if terms and not spared:
                total += lexicon.weights[max(terms, key=lambda t: len(t.rstrip()))]
        want = total / np.log2(3 + text.count(" ")) if total else 0.0
        assert lexicon.weighed(text) == pytest.approx(want)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality.scored(docs, quality.fit(docs, labels))
    held = out.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0).join(labels, "doc_id")
    pairs = [(r["quality"], int(r["keep"])) for r in held.select("quality", "keep").collect()]
    assert sum(a == b for a, b in pairs) / len(pairs) >= 0.95
    rates = quality.site_rates(spark.createDataFrame([("a", "x", 1.0)] * 500 + [("a", "y", 0.0)] + [("b", "x", 0.0)] * 500 + [(None, None, 1.0)], "host string, path string, p double"))
    by = {(r["host"], r["path"]): r["path_rate"] for r in rates.collect()}
    assert by[("a", "x")] > by[("a", "y")] > 0.5 > by[("b", "x")] and 0.4 < by[(None, None)] < 0.7
    assert quality.scored(docs.limit(0), quality.learn([])).count() == 0
    odd = documents(spark, ODD).withColumn("keep", F.lit("clash")).withColumn("source", F.lit(None).cast("string"))
    assert quality.scored(odd, quality.learn([])).filter("keep").count() == len(ODD)


def test_quality_reads_whole_texts():
    """What comes after the first words counts as much as they do."""
    varied = " ".join(f"w{i}" for i in range(200))
    at = quality.FEATURES.index("variety")
    assert quality.features(varied)[at] == 1.0
    assert quality.features(varied + " x" * 600)[at] == pytest.approx((1 + 3 / 200) / 4)
    assert quality.features("x " * 600 + varied)[at] == pytest.approx((1 + 3 / 200) / 4)
    assert quality.features(varied + " w199")[at] == pytest.approx((200 + 199) / 400)
    assert quality.features("")[at] == 0


def test_quality_rates(spark):
    """Rates against closed forms over plain lists."""
    rng = random.Random(2)
    rows = [(h, p, min(1.0, max(0.0, rng.gauss({"a": 0.8, "b": 0.3, "c": 0.5}[h] + 0.1 * (p == "y"), 0.1)))) for h in "abc" for p in "xyz" for _ in range(rng.randrange(1, 60))]
    mean = lambda xs: sum(xs) / len(xs)
    hosts = {h: [p for a, _, p in rows if a == h] for h in "abc"}
    paths = {(a, b): [p for c, d, p in rows if (c, d) == (a, b)] for a, b, _ in rows}
    g = mean([p for *_, p in rows])
    pull = lambda spread, left: max(5.0, min(1e4, spread / left - 1 if left > 0 else 1e4))
    host_pull = pull(g * (1 - g), mean([(mean(x) - g) ** 2 for x in hosts.values()]) - mean([g * (1 - g) / len(x) for x in hosts.values()]))
    h_rate = {h: mean(x) for h, x in hosts.items()}
    b = lambda h: h_rate[h] * (1 - h_rate[h])
    path_pull = pull(mean([b(h) for h, _ in paths]), mean([(mean(x) - h_rate[h]) ** 2 for (h, _), x in paths.items()]) - mean([b(h) / len(x) for (h, _), x in paths.items()]))
    got = {(r["host"], r["path"]): r for r in quality.site_rates(spark.createDataFrame(rows, "host string, path string, p double"), strength=5.0).collect()}
    assert got.keys() == paths.keys()
    for (h, p), x in paths.items():
        host = (sum(hosts[h]) + host_pull * g) / (len(hosts[h]) + host_pull)
        assert got[h, p]["host_rate"] == pytest.approx(host)
        assert got[h, p]["path_rate"] == pytest.approx((sum(x) + path_pull * host) / (len(x) + path_pull))


@pytest.mark.parametrize("large, block, pivots", [(False, 64, 5), (True, 64, 5), (False, 8, None)])
def test_top_k(spark, monkeypatch, large, block, pivots):
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "NEAR", 50)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(150, 6)) + c for c in (0, 4, -4)]) * (2.0**16 if large else 1)
    x[7] = x[8] = x[9]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (1000, [1.0, 2.0]), (None, [1.0] * 6)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 50 = 0", k=10, block=block, query_block=4, pivots=pivots)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(1024 * x).astype("i8").astype(object)
    want = {}
    for q in range(0, len(x), 50):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(len(x)) if i != q)[:10]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_packing(spark):
    texts = [*ODD, *[r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60).collect()]]
    out = packing.packed(documents(spark, texts), queries.RANKS, vocabularies.PATTERN, window=128, group=30).collect()
    by_doc, by_window = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = tokens.ids(text or "", queries.RANKS, vocabularies.PATTERN) + bytes(4)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids) // 4)
            assert r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    assert sum(r["length"] for r in out) / (128 * len(by_window)) > 0.9


def test_packing_ids(spark):
    """Ids against the tokenizers library, ids of documents beyond 2^53 beside null ones, repeated rows, an empty table."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    texts = [t or "" for t in ODD] + ["<|endoftext|> and <|endoftext|>"]
    rows = [(LARGE + 2 * i, t) for i, t in enumerate(texts)] + [(None, "no id"), (LARGE, texts[0])]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), queries.RANKS, vocabularies.PATTERN, window=16).collect()
    for i, text in enumerate(texts):
        ids = np.array([*own.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        got = {(r["start"], r["ids_crc32"]) for r in out if r["doc_id"] == LARGE + 2 * i}
        assert got == {(a, zlib.crc32(ids[a : a + 16].tobytes())) for a in range(0, len(ids), 16)}
    assert sum(r["doc_id"] is None for r in out) >= 1 and sum(r["doc_id"] == LARGE for r in out) == 2
    assert packing.packed(documents(spark, []), queries.RANKS, vocabularies.PATTERN).count() == 0


def test_best_fit():
    rng = random.Random(2)
    lengths = sorted((rng.randrange(1, 100) for _ in range(400)), reverse=True)
    rooms = []
    for size, (window, offset) in zip(lengths, packing.best_fit(lengths, 100), strict=True):
        fitting = [r for r in rooms if r >= size]
        if fitting:
            assert rooms[window] == min(fitting)
        else:
            assert window == len(rooms)
            rooms.append(100)
        assert offset == 100 - rooms[window]
        rooms[window] -= size


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>top</header><nav><ul><li><a href="/x">x</a></ul></nav>
<div class="ad">buy</div><article><h1>Head &amp; line</h1><p>First  para,\n graph.<p>Second <b>bold</b> text &lt;b&gt;.<br><!-- no --><script>var a = "</p>";</script></article>
<div class="comments"><p>reader</p></div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    assert html_main.extract(PAGE) == "Head & line\nFirst para, graph.\nSecond bold text <b>."
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert "First para, graph." in html_main.extract(plain) and "reader" not in html_main.extract(plain)
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<p>" * 3000 + "deep")], "page_id long, url string, html string")
    got = [tuple(r) for r in html_main.main_text(df).orderBy("page_id").collect()]
    assert html_main.main_text(df.limit(0)).count() == 0
    large = spark.createDataFrame([(LARGE, "u", PAGE), (None, "u", None)], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in html_main.main_text(large).collect()} == {LARGE, None}
    assert [g[3] for g in got][:4] == [len(html_main.extract(PAGE)), 0, 0, 0] and got[4][2] == "deep"


def test_html_blocks():
    named = html_main.extract(f'<article class="share-price notice-board"><p>{PROSE}</p><div class="related-work"><p>More of it.</p></div><p><a href="x">only a link</a></p><ul><li><a href="y">menu</a></li></ul><div class="cookie-banner-box"><p>We use cookies</p></div></article>')
    assert named == f"{PROSE.strip()}\nMore of it.\nonly a link"
    assert html_main.extract('<article><p title="broken>oops it is</p><p>More of it.</p></article>') == "oops it is\nMore of it."
    assert html_main.extract('<article><p title="a > b">Text.</p></article>') == "Text."


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "text", '<a x="' * 20_001, '<a "' * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<b>" * 9_000 + "<p>x</p>" * 9_000, "<" * 50_000, "<!--" * 20_000, "<script>" * 20_000, '<a x="' * 20_001 + '">'])
def test_html_hostile(page):
    """Time in proportion to the page."""
    began = time.perf_counter()
    html_main.extract(page)
    assert time.perf_counter() - began < 3


def naive_secrets(text):
    """The base rules by trying every place in turn."""
    ascii_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    value = lambda at, chars: next((k for k in range(at, len(text)) if text[k] not in chars), len(text))

    def assign(at):
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(c.lower() if c in ascii_ else c for c in text[at : at + len(name)]) == name:
                k = at + len(name)
                k += text[k : k + 1] in ('"', "'") and k < len(text)
                k = value(k, " ")
                if text[k : k + 1] not in (":", "=") or k >= len(text):
                    return None
                k = value(k + 1, " ")
                k += text[k : k + 1] in ('"', "'") and k < len(text)
                end = value(k, ascii_ + "+/_.=-")
                return (end, end - k >= 8) if end > k else None
        return None

    def run(at, first, chars, least):
        end = value(at + len(first), chars)
        return (end, end - at >= least) if text.startswith(first, at) and end > at + len(first) else None

    out = []
    for order, (kind, rule) in enumerate((("assign", assign), ("access", lambda at: run(at, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16)), ("hex", lambda at: run(at, "", "0123456789abcdef", 32)))):
        at = 0
        while at < len(text):
            if (hit := rule(at)) is None:
                at += 1
                continue
            if hit[1]:
                out.append((at, order, hit[0], kind))
            at = hit[0]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_secrets_brute_force():
    rng = random.Random(6)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "ſecret", '"', "'", " ", ":", "=", "abcdefgh", "x.=-/", "é", "AKIA", "ABCDEFGHIJKL", "0123456789ab", "0a" * 16, "f", "A1"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [x for x in secrets.find(text) if x[2] in secrets.BASE_KINDS] == naive_secrets(text), text


def test_secrets(spark):
    text = 'password = "abcdEFGH1234" AKIA' + "A" * 12 + " tail " + "0a" * 16 + " secret: short token=token: abcdefgh12 API_KEY:xxxxxxxx"
    kinds = [s[2] for s in secrets.find(text)]
    assert kinds == ["assign", "access", "hex", "assign"]
    assert secrets.masked(text, secrets.joined(secrets.find(text))).count("[SECRET]") == 4
    docs = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (None, text), (4, "")], "doc_id long, text string")
    ledger = secrets.scan_blobs(docs).cache()
    assert ledger.count() == 2
    found = secrets.findings(docs, ledger).collect()
    assert len(found) == 6 and {r["n_assign"] for r in found if r["doc_id"] in (1, 2, None)} == {2}
    assert secrets.scan_blobs(docs, ledger).count() == 0
    assert secrets.scan_blobs(docs, ledger, rule_version=2).count() == 2
    more = docs.union(spark.createDataFrame([(9, "token: newsecret99"), (None, None)], "doc_id long, text string"))
    assert [r["n_assign"] for r in secrets.findings(more, ledger).filter("doc_id = 9").collect()] == [None]
    grown = secrets.advanced(more, ledger)
    assert grown.count() == 3 and secrets.findings(more, grown).filter("n_assign is null").count() == 0
    assert secrets.advanced(more, grown).count() == 3
    assert secrets.advanced(docs.limit(0)).count() == 0 == secrets.findings(docs.limit(0), ledger).count()


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, np.repeat(base[:6], 12, axis=0) + rng.normal(size=(72, 16)) * 0.05, base[:3], base[:1]])
    labels = [i % 2 for i in range(60)] + [j % 2 for j in range(6) for _ in range(12)] + [0, 1, 0, None]
    rows = [(i, [float(v) for v in r], lab) for i, (r, lab) in enumerate(zip(x, labels, strict=True))] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("inf")] * 16, 0), (503, [None] + [1.0] * 15, 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(x)), 2) if labels[i] is not None and labels[i] == labels[j] and unit[i] @ unit[j] >= 0.98]
    found = sum(n for n, _, _ in got.values()) / 2
    assert 0.97 * len(pairs) <= found <= len(pairs) and len(pairs) > 100
    want = brute_components(pairs, range(len(x)))
    assert sum(got[i][1] == want[i] for i in want) >= 0.97 * len(want)
    assert [got[i] for i in (500, 501, 502, 503)] == [(0, i, True) for i in (500, 501, 502, 503)]


@pytest.mark.parametrize("parts", [4, 64, 211])
def test_vectors_recall(spark, monkeypatch, parts):
    """A large group of near copies, isolated pairs at the threshold's edge, over few and many partitions and small chunks."""
    rng = np.random.default_rng(5)
    group = rng.normal(size=32) + rng.normal(size=(400, 32)) * 0.14
    far = rng.normal(size=(600, 32))
    twins = far[:200] / np.linalg.norm(far[:200], axis=1)[:, None] + rng.normal(size=(200, 32)) * 0.2 / 32**0.5 * rng.uniform(0.3, 1, size=(200, 1))
    x = np.concatenate([group, far, twins])
    monkeypatch.setattr(vector_dedup, "CHUNK", 150)
    vectors = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(vectors).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert 20_000 < want.sum() < 150_000 and want[600:].sum() > 50
    assert all(got[i] <= n for i, n in enumerate(want.tolist()))
    assert sum(got.values()) >= 0.995 * want.sum()
    assert sum(got[i] for i in range(600, len(x))) >= 0.97 * want[600:].sum()


@pytest.mark.parametrize("clusters", [1, 2, 5, 20])
def test_vectors_clusters(spark, clusters):
    """A label of 20,000 vectors in tight clusters, whose vectors don't link, and 400 planted pairs just above the threshold."""
    rng = np.random.default_rng(clusters)
    n, dims, within = 20_000, 64, 0.95
    centre = rng.normal(size=(clusters, dims))
    centre = (centre / np.linalg.norm(centre, axis=1)[:, None])[np.arange(n) % clusters]
    rest = rng.normal(size=(n, dims))
    x = within**0.5 * centre + (1 - within) ** 0.5 * rest / np.linalg.norm(rest, axis=1)[:, None]
    # twins differ from their originals across the cluster's centre, so they lie as far from it
    c, first = centre[:400], x[:400] - (x[:400] * centre[:400]).sum(axis=1)[:, None] * centre[:400]
    first /= np.linalg.norm(first, axis=1)[:, None]
    second = rng.normal(size=(400, dims))
    for away in (c, first):
        second -= (second * away).sum(axis=1)[:, None] * away
    second /= np.linalg.norm(second, axis=1)[:, None]
    part = (0.981 - within) / (1 - within)
    twins = within**0.5 * c + (1 - within) ** 0.5 * (part * first + (1 - part**2) ** 0.5 * second)
    x = np.concatenate([x, twins])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = sum(int((unit[i : i + 1000] @ unit.T >= 0.98).sum()) for i in range(0, len(x), 1000)) // 2 - len(x) // 2
    frame = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": 1})
    got = vector_dedup.near_duplicates(spark.createDataFrame(frame.values.tolist(), "vec_id long, embedding array<double>, label long")).agg(F.sum("n_links")).first()[0] / 2
    print("recall", clusters, got / linked)
    assert 300 < linked < 500 and (0.97 if clusters > 1 else 0.92) * linked <= got <= linked


def test_vectors_ids(spark):
    rows = [(LARGE, [1.0, 2.0], 2**53 + 1), (LARGE + 2, [1.0, 2.0], 2**53 + 1), (None, [1.0, 2.0], 2**53 + 1), (5, [1e200, 2e200], 2**53 + 1), (6, [1.0, 2.0], None), (6, [1.0, 2.0], None)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").coalesce(1)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(LARGE, 2, 5, False), (LARGE + 2, 2, 5, False), (None, 0, None, True), (5, 2, 5, True), (6, 0, 6, True), (6, 0, 6, True)]))
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label long")).count() == 0


PROSE = "The method reads every row, once; it keeps what it finds, and says so. " * 6


def test_html_inline():
    article = f"<article><h1>A heading of a page</h1><p>{PROSE}<b>ten</b> and see <a href='/x'>the report</a> for more, <code>x</code>.</p></article>"
    text = html_main.extract(f"<html><body><nav>menu</nav>{article}</body></html>")
    assert text.startswith("A heading of a page\n") and text.endswith("ten and see the report for more, x.")
    bare = f"<html><body><div><h1>Title</h1><h2>Part</h2><p>{PROSE}<em>very</em> <strong>much</strong> <code>y</code>.</p><ul><li>one</li><li>two</li></ul><p>{PROSE}</p></div><div><a href='/a'>Home</a> | <a href='/b'>About</a></div></body></html>"
    assert html_main.extract(bare) == f"Title\nPart\n{PROSE}very much y.\none\ntwo\n{PROSE.strip()}"


@pytest.mark.parametrize("open_, close", [('<div class="layout with-sidebar"><article>', "</article></div>"), ('<article class="post comments-open">', "</article>"), ('<article><section id="related-work">', "</section></article>"), ('<div class="with-sidebar"><main>', "</main></div>")])
def test_html_names(open_, close):
    text = html_main.extract(f"<html><body>{open_}<h2>Short</h2><p>{PROSE}</p>{close}</body></html>")
    assert text == f"Short\n{PROSE.strip()}"
    both = html_main.extract(f"<html><body><article><p>{PROSE}</p><section id='related-work'><h2>Related</h2><p>{PROSE}</p></section><div class='share'>Share it</div></article></body></html>")
    assert both == f"{PROSE.strip()}\nRelated\n{PROSE.strip()}"


COMMENTS = "I think that this is, on the whole, a fine idea; others, though, may not agree. " * 12
ARTICLE, ARTICLE_TEXT = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>", f"Title\n{PROSE.strip()}\n{PROSE.strip()}"


@pytest.mark.parametrize("name", ["comments", "user-comments", "comment-body", "userComments", "reader-replies", "advert-slot", "ad-wrapper", "sponsored"])
@pytest.mark.parametrize("page", ["<article>{0}<section class='{1}'><h3>Say</h3><p>{2}</p></section></article>", "<div>{0}</div><div id='{1}'><h3>Say</h3><p>{2}</p></div>", "<article>{0}</article><section class='{1}'><article class='{1}'><p>{2}</p></article></section>"])
def test_html_comments(page, name):
    """Comments and adverts go, however long they are, with and without a marked article."""
    assert html_main.extract(page.format(ARTICLE, name, COMMENTS)) == ARTICLE_TEXT


@pytest.mark.parametrize("name", ["site-footer", "more-stories", "newsletter-signup", "main-nav", "sidebar widget", "related"])
def test_html_compound_names(name):
    beside = f"<div class='{name}'><p>Copyright, all rights are ours; write to us.</p></div>"
    assert html_main.extract(f"<article>{ARTICLE}{beside}</article>") == ARTICLE_TEXT
    assert html_main.extract(f"<div>{ARTICLE}</div>{beside}") == ARTICLE_TEXT
    # around the article it tells nothing, nor do titles and states
    assert html_main.extract(f"<div class='{name}'>{ARTICLE}</div>") == ARTICLE_TEXT
    assert html_main.extract(f"<article>{beside[:-10]}</p></div><h2 id='comments-on-{name[:4]}'>Told</h2><p class='no-comments'>{PROSE}</p></article>").endswith(f"Told\n{PROSE.strip()}")


def test_html_forms():
    assert html_main.extract(f"<form><article>{ARTICLE}</article><input></form>") == ARTICLE_TEXT
    assert html_main.extract(f"<form action=x>{ARTICLE}<div><label>Name</label></div></form>") == ARTICLE_TEXT
    assert html_main.extract(f"<article>{ARTICLE}<form><p>Your mail please</p></form></article>") == ARTICLE_TEXT
    assert html_main.extract(f"<div>{ARTICLE}</div><form><label>Your mail</label><p>and more</p></form>") == ARTICLE_TEXT


def test_html_beside():
    """Tables and quotes between or beside kept blocks stay; within a marked article sparse paths that aren't prose go by their ratios."""
    inner = f"<p>{PROSE}</p><table><tr><th>k</th><th>v</th></tr><tr><td>one</td><td>2</td></tr></table><blockquote><p>Short quote</p></blockquote>"
    assert html_main.extract(f"<div>{inner}<p>{PROSE}</p></div>") == f"{PROSE.strip()}\nk\nv\none\n2\nShort quote\n{PROSE.strip()}"
    assert html_main.extract(f"<div>{inner}</div><div><a href='x'>a</a> <a href='y'>b</a></div>") == f"{PROSE.strip()}\nk\nv\none\n2\nShort quote"
    sparse = "<section><div>Like</div><div><div>Tweet</div><div><div>Mail</div><section>Pin</section></div></div></section>"
    assert html_main.extract(f"<article><p>{PROSE}</p><p>Short.</p><table><tr><td>1</td></tr></table>{sparse}</article>") == f"{PROSE.strip()}\nShort.\n1"
    assert html_main.extract("<div class='comments'><p>all of it</p></div>") == "all of it"
