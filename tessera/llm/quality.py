"""Quality by hierarchical empirical Bayes over sites.

Three sources of evidence are combined in log odds: a document classifier
(logistic regression on shape features of the text), the posterior rate of the
document's host and that of its path on the host. Here ``source`` is the host and
``lang`` the path below it, as a crawl keeps one tree a language.

The rates are shrunk: a host's rate is pulled to the global one by as many
pseudo-documents as the hosts' own spread asks for (method of moments), a path's
rate to its host's by as many as the paths' spread within hosts asks for, so a
sparse site counts as its parent. They come from one
grouped aggregation of classifier scores by (host, path), with map-side
combining; only sums a path are moved, never texts, and a host that holds a third
of all rows is a few sums a task.

A document is kept if its combined posterior is at least a half. Null and empty
texts have features of an empty text; null hosts and paths are sites of their
own; repeated rows count as often as they occur and score alike; an empty table
gives an empty result. Without labelled rows of both kinds every document scores
a half and is kept. Input columns stay; columns named like an output are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import checkpointed, small_batches, whole
from tessera.llm.toxicity import labelled

#: The most labelled rows used for training, by hash of their ids.
MAX_LABELLED = 8_000
FEATURES = ("bias", "signs", "runs", "repeats", "variety", "capitals", "log_words", "word_length", "no_sentence", "digits")
#: A sign that is repeated, as prose seldom has it.
RUNS = re.compile(r"([^\w\s.])\1")
SIGNS = re.compile(r"[^\w\s.,;:!?'\"()-]")
SENTENCES = re.compile(r"[.!?\u3002\uff01\uff1f]")
DIGITS = re.compile(r"\d")
#: Words of a window whose different words are counted; the last window ends with the text.
WINDOW = 200


def features(text: str) -> list[float]:
    """Shape of a text: rates, so that length alone says little."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    m = max(1, n)
    upper = sum(map(str.isupper, words))
    repeats = sum(map(eq, words, words[1:]))
    # different words among those of a window, over all windows of the text: in a whole text the share falls with its length
    parts = -(-n // WINDOW)
    starts = [max(0, min(i * WINDOW, n - WINDOW)) for i in range(parts)]
    variety = sum(len(set(words[s : s + WINDOW])) for s in starts) / max(1, parts * min(n, WINDOW))
    return [1.0, min(1.0, 10 * len(SIGNS.findall(text)) / size), min(1.0, len(RUNS.findall(text)) / m), repeats / m, variety, upper / m, math.log1p(n) / 10, min(3.0, size / m / 10), float(SENTENCES.search(text) is None), min(1.0, 5 * len(DIGITS.findall(text)) / size)]


@dataclass(frozen=True)
class Classifier:
    weights: tuple[float, ...]

    def log_odds(self, text: str) -> float:
        return max(-12.0, min(12.0, sum(w * x for w, x in zip(self.weights, features(text), strict=True))))


def learn(rows: list[tuple[str, int]], prior: float = 0.05, steps: int = 40) -> Classifier:
    """Logistic regression by damped Newton steps; ``prior``: the pull of all weights but the bias to 0."""
    ys = np.array([y for _, y in rows], dtype=float)
    if not 0 < ys.sum() < len(ys):
        return Classifier((0.0,) * len(FEATURES))
    xs = np.array([features(t) for t, _ in rows])
    pull = np.full(xs.shape[1], prior)
    pull[0] = 1e-6
    w = np.zeros(xs.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        step = np.linalg.solve((xs * (p * (1 - p) + 1e-9)[:, None]).T @ xs + np.diag(pull), xs.T @ (ys - p) - pull * w)
        w += step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(tuple(float(x) for x in w))


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Classifier:
    return learn(labelled(documents, labels, "quality", most))


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _pull(spread: float | None, variance: float | None, noise: float | None, strength: float) -> float:
    """Pseudo-documents at the parent's rate: the size of a beta prior for the variance that is left without the noise of sampling."""
    left = max(0.0, (variance or 0.0) - (noise or 0.0))
    return max(strength, min(1e4, (spread or 0.0) / left - 1 if left > 0 else 1e4))


def site_rates(scores: DataFrame, strength: float = 20.0) -> DataFrame:
    """(host, path, host_n, path_n, global_rate, host_rate, path_rate) from rows of (host, path, p).

    Method of moments at both levels. Hosts: of the mean square distance v of their
    rates from the global rate g, the part that sampling explains, the mean of
    g(1-g)/n, is taken off; a host counts g(1-g)/v - 1 pseudo-documents at g, at least
    ``strength`` and at most 10,000. Paths likewise, by their distances from their
    host's rate h, with the mean of h(1-h) in place of g(1-g), at the host's posterior.
    """
    paths = checkpointed(scores.groupBy("host", "path").agg(F.count("*").alias("path_n"), F.sum("p").alias("path_sum")))
    hosts = checkpointed(paths.groupBy("host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum")))
    g = hosts.agg((F.sum("host_sum") / F.sum("host_n")).alias("g")).first()["g"]
    rate, path_rate = F.col("host_sum") / F.col("host_n"), F.col("path_sum") / F.col("path_n")
    own = F.lit(g).cast("double")
    host_moments = hosts.agg(F.avg((rate - own) ** 2).alias("v"), F.avg(own * (1 - own) / F.col("host_n")).alias("noise")).first()
    joined = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    bernoulli = rate * (1 - rate)
    path_moments = joined.agg(F.avg(bernoulli).alias("m"), F.avg((path_rate - rate) ** 2).alias("v"), F.avg(bernoulli / F.col("path_n")).alias("noise")).first()
    host_pull = _pull(None if g is None else g * (1 - g), host_moments["v"], host_moments["noise"], strength)
    path_pull = _pull(path_moments["m"], path_moments["v"], path_moments["noise"], strength)
    joined = joined.withColumn("global_rate", own).withColumn("host_rate", (F.col("host_sum") + host_pull * own) / (F.col("host_n") + host_pull))
    joined = joined.withColumn("path_rate", (F.col("path_sum") + path_pull * F.col("host_rate")) / (F.col("path_n") + path_pull))
    return joined.select("host", "path", "host_n", "path_n", "global_rate", "host_rate", "path_rate")


OUTPUT = ("classifier_score", "host_rate", "path_rate", "score", "keep")


#: Up to so many sites, their rates (some 100 bytes each) are sent to every executor; beyond, they are joined by a shuffle.
BROADCAST_SITES = 50_000


def scored(documents: DataFrame, classifier: Classifier, host_col: str = "source", path_col: str = "lang", text_col: str = "text", weight: float = 0.5, keep_cols: list[str] | None = None) -> DataFrame:
    """``documents`` (of it ``keep_cols``, all by default) with classifier_score, host_rate, path_rate, score and keep.

    ``weight``: how much a site's evidence counts against that of the text.
    """
    if host_col == path_col:
        raise ValueError("host and path need columns of their own")
    small_batches(documents.sparkSession)
    documents = documents.drop(*OUTPUT)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield text.map(classifier.log_odds).astype("float64")

    # else Spark takes the column apart and computes it again for a filter
    log_odds = F.pandas_udf(run, "double").asNondeterministic()(whole(text_col))
    scores = documents.select(F.col(host_col).alias("host"), F.col(path_col).alias("path"), log_odds.alias("log_odds"))
    rates = checkpointed(site_rates(scores.withColumn("p", _sigmoid(F.col("log_odds")))))
    rates = rates.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("global_rate").alias("__global"), "host_rate", "path_rate")
    if rates.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        rates = F.broadcast(rates)
    rows = documents.withColumn("__log_odds", log_odds)
    both = rows.join(rates, F.col(host_col).eqNullSafe(F.col("__host")) & F.col(path_col).eqNullSafe(F.col("__path")), "left")
    posterior = F.col("__log_odds") + weight * (_logit(F.col("path_rate")) - _logit(F.col("__global")))
    return both.select(
        *[F.col(c) for c in (documents.columns if keep_cols is None else keep_cols)],
        _sigmoid(F.col("__log_odds")).alias("classifier_score"),
        "host_rate",
        "path_rate",
        _sigmoid(posterior).alias("score"),
    ).withColumn("keep", F.col("score") >= 0.5)
