"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: NFKC and lower case, homoglyphs to Latin letters, digit
and symbol substitutions inside words to the letters they stand for, marks that
split a word's letters removed. The lexicon is learned from labelled texts:
folded words and stems (a word's first letters) that toxic texts hold far more
often than others, weighted by smoothed log odds. A stem that also begins many
harmless words gets exception phrases: words, or a pair of words, that hold it in
texts labelled harmless; inside them a match does not count.

A text's evidence is the summed weight of its matches against the logarithm of
its length in words, so a match weighs less in a long text; a one-dimensional
logistic regression over the training texts turns it into a score.

Null and empty texts score as texts without a match. Ties between terms go to the
lesser term. Repeated rows score alike, an empty table gives an empty result.
Without labelled rows of both kinds the lexicon is empty and all texts score alike. Rows
whose id is null take no part in training. Other columns are kept as they are;
score columns of clashing names are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import small_batches, whole

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ӏ": "l", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
#: Digits and signs that stand for letters within a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: The most labelled rows used for training, by hash of their ids.
MAX_LABELLED = 6_000

GLYPHS = str.maketrans(HOMOGLYPHS)
DIGITS = str.maketrans(SUBSTITUTES)
HIDDEN = re.compile("[­​-‏⁠﻿]")
MIXED = re.compile(r"(?:[^\W\d_]|[@$])*[\d@$][\w@$]*")
SPLIT = re.compile(r"(?<![^\W\d_])([^\W\d_])[.*_-](?=[^\W\d_](?:[.*_-][^\W\d_])+(?![^\W\d_]))|(?<=[.*_-][^\W\d_])[.*_-](?=[^\W\d_](?![^\W\d_]))")
WORD = re.compile(r"[^\W\d_]+")


#: The most words whose folded form a process remembers.
REMEMBERED = 100_000


def _letters(match: re.Match) -> str:
    """Substitutes count only in a word that holds letters: a number stays."""
    word = match[0]
    return word.translate(DIGITS) if any(c.isalpha() for c in word) else word


def _fold(word: str) -> str:
    """The folded words of what stands between white space, joined by one space; "" if none."""
    if word.isascii():
        if (bare := word.strip(".,;:!?")).isalpha() or not bare:
            return bare
    else:
        word = HIDDEN.sub("", unicodedata.normalize("NFKC", word)).lower().translate(GLYPHS)
    if not word.isalpha():
        word = SPLIT.sub(lambda m: m[1] or "", MIXED.sub(_letters, word))
    return " ".join(WORD.findall(word))


class _Folds(dict):
    def __missing__(self, word: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = _fold(word)
        return out


FOLDS = _Folds()


def folded(text: str) -> str:
    """Folded words, each after one space, and a last space."""
    return f" {' '.join(filter(None, map(FOLDS.__getitem__, text.lower().split())))} "


@dataclass
class Lexicon:
    """weights: by folded term, a stem as " stem", a word as " word "; exceptions: folded phrases; slope and offset of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    offset: float = -2.0
    matcher: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "matcher"} | {"matcher": None}

    def _automaton(self):
        if self.matcher is None:
            own = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                own.add_word(term, (len(term.rstrip()), weight))
            for phrase in self.exceptions:
                own.add_word(phrase, (len(phrase), None))
            if len(own):
                own.make_automaton()
            self.matcher = own
        return self.matcher

    def evidence(self, text: str) -> float:
        return self.weighed(folded(text))

    def weighed(self, words: str) -> float:
        """Summed weight of the matches in a folded text outside exceptions, against length; the longest term counts at each word."""
        own = self._automaton()
        if not len(own):
            return 0.0
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in own.iter(words):
            if weight is None:
                spared.append((end + 1 - size, end))
                continue
            end -= words[end] == " "
            start = end + 1 - size
            if best.get(start, (0, 0.0))[0] < size:
                best[start] = (size, weight)
        inside = _covered(spared)
        total = sum(w for start, (_, w) in best.items() if not inside(start))
        return total / math.log2(3 + words.count(" ")) if total else 0.0

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.evidence(text) + self.offset))))


def _covered(spans: list[tuple[int, int]]):
    """Tells whether a place lies in one of ``spans`` (end exclusive), in the time of a search."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return lambda at: (k := bisect_right(starts, at)) > 0 and at < ends[k - 1]


def learn(rows: list[tuple[str, int]], least: int = 4, ratio: float = 25.0) -> Lexicon:
    """From (text, label) rows, bounded by the caller.

    A word's support is the number of toxic texts that hold it, or of different
    words before it there, whichever is less: what only copies of one text share
    has one context. A stem is taken only where several words bear it.
    """
    toxic, clean = Counter(), Counter()
    before: dict[str, set[str]] = defaultdict(set)
    n = [sum(1 for _, y in rows if not y), sum(1 for _, y in rows if y)]
    rows = [(folded(text), y) for text, y in rows]
    for text, y in rows:
        words = text.split()
        (toxic if y else clean).update(set(words))
        if y:
            for a, b in zip(["", *words], words, strict=False):
                before[b].add(a)
    if not all(n):
        return Lexicon({})
    support: Counter = Counter()
    against: Counter = Counter()
    bearers: Counter = Counter()
    for w, k in toxic.items():
        support[f" {w} "] = k = min(k, len(before[w]))
        for size in range(3, min(8, len(w) + 1)):
            support[f" {w[:size]}"] += k
            bearers[f" {w[:size]}"] += 1
    for w, k in clean.items():
        for t in (f" {w} ", *(f" {w[:size]}" for size in range(3, min(8, len(w) + 1)))):
            if t in support:
                against[t] += k

    def sure(t: str) -> bool:
        p, q = support[t] / n[1], (against[t] + 0.5) / n[0]
        return support[t] >= least and p > ratio * q and p - q > 4 * math.sqrt(q / n[1]) and (t.endswith(" ") or bearers[t] >= 3)

    kept: dict[str, float] = {}
    covered: Counter = Counter()
    for t in sorted((t for t in support if sure(t)), key=lambda t: (-support[t], -len(t), t)):
        stems = [t[:k] for k in range(4, len(t)) if t[:k] in kept]
        # a term within a kept stem, or a stem that longer kept terms make up, adds nothing
        if stems or covered[t] >= 0.9 * support[t]:
            continue
        kept[t] = math.log((support[t] + 0.5) / (n[1] + 1)) - math.log((against[t] + 0.5) / (n[0] + 1))
        for k in range(4, len(t)):
            covered[t[:k]] += support[t]
    lexicon = Lexicon(kept)
    lexicon.exceptions = _spared(lexicon, rows)
    lexicon.matcher = None
    lexicon.slope, lexicon.offset = _logistic([lexicon.weighed(t) for t, _ in rows], [y for _, y in rows])
    return lexicon


def _spared(lexicon: Lexicon, rows: list[tuple[str, int]], least: int = 3) -> tuple[str, ...]:
    """Phrases around matches that only folded texts labelled harmless hold."""
    harmless, toxic = Counter(), Counter()
    own = lexicon._automaton()
    for words, y in rows:
        seen = set()
        for end, (size, _) in own.iter(words):
            start = end - (words[end] == " ") + 1 - size
            stop = words.find(" ", start + 1) + 1
            before, after = words.rfind(" ", 0, max(0, start)), words.find(" ", stop)
            seen |= {words[start:stop]}
            seen |= {words[before:stop]} if start and before >= 0 else set()
            seen |= {words[start : after + 1]} if after > 0 else set()
        (toxic if y else harmless).update(seen)
    return tuple(sorted(p for p, k in harmless.items() if k >= least and not toxic[p]))


def _logistic(xs: list[float], ys: list[int], steps: int = 50, prior: float = 1e-2) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a slight pull to 0."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        ga, gb, haa, hab, hbb = -prior * a, -prior * b, prior, 0.0, prior
        for x, y in zip(xs, ys, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            w = p * (1 - p)
            ga += (y - p) * x
            gb += y - p
            haa += w * x * x
            hab += w * x
            hbb += w
        det = haa * hbb - hab * hab
        if det < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = max(1.0, abs(da) / 4, abs(db) / 4)
        a, b = a + da / scale, b + db / scale
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b


def labelled(documents: DataFrame, labels: DataFrame, label: str, most: int = MAX_LABELLED, learning: bool = True) -> list[tuple[str, int]]:
    """(text, label) rows of the learning part: crc32 of the id as text, modulo 5, isn't 0; at most ``most``, by hash of the id.

    The ids of that bounded sample are small enough to broadcast, so the texts
    of all other documents stay where they are.
    """
    rows = labels.select(F.col("doc_id").alias("labelled"), F.col(label).cast("int").alias("y")).filter("labelled is not null and y is not null")
    rows = rows.filter(F.pmod(F.crc32(F.col("labelled").cast("string").cast("binary")), F.lit(5)) != 0) if learning else rows
    # a copied label row counts once; of contradicting ones the greater label
    rows = rows.groupBy("labelled").agg(F.max("y").alias("y"))
    sample = rows.orderBy(F.xxhash64("labelled"), "labelled").limit(most)
    texts = documents.select("doc_id", whole("text").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
    return [(r["text"], r["y"]) for r in texts.orderBy("doc_id", "text").select("text", "y").toLocalIterator()]


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Lexicon:
    return learn(labelled(documents, labels, "toxic", most))


OUTPUT = ("held_out", "score", "predicted")


def scored(documents: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``documents`` with held_out, score and predicted."""
    small_batches(documents.sparkSession)
    documents = documents.drop(*OUTPUT)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield text.map(lexicon.score).astype("float64")

    return (
        documents.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False)))
        .withColumn("score", F.pandas_udf(run, "double")(whole(text_col)))
        .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    )
