"""Document fingerprints by Lempel-Ziv phrases: what a compressor would learn from a text.

A text's bytes are parsed into phrases, each the longest one known so far and one byte more
(LZ78); the set of phrases is what texts share if one helps to compress the other. The
fingerprint is the SIZE least hashes of the set, in hexadecimal; likeness is the share of common
hashes among the least of both sets (their Jaccard coefficient, exact for sets of fewer phrases).

Texts are dealt out in buckets by range of their order, so a text's neighbour is the row
behind it; a bucket also gets a copy of the next bucket's first row. Bounds of buckets come from
approximate percentiles; a key that holds more than a bucket is split by the texts' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import lean, partitions, small_batches, whole

#: Hashes of a fingerprint, 32 bits each.
SIZE = 128

_PRIME, _MASK = 0x100000001B3, (1 << 64) - 1


class Parse:
    """The phrases of a text so far; ``text`` may be added to, and what was added since a mark taken back."""

    def __init__(self):
        self.known: dict[int, int] = {}  # (node, byte) as one number -> node, both counted in steps of 256
        self.hashes, self.keys, self.node = [0xCBF29CE484222325], [], 0

    def add(self, data: bytes) -> None:
        known, hashes, keys, node = self.known, self.hashes, self.keys, self.node
        get, size = known.get, len(hashes) << 8
        for byte in data:
            key = node | byte
            node = get(key, -1)
            if node < 0:
                known[key] = size
                size += 256
                hashes.append(((hashes[key >> 8] ^ (byte + 1)) * _PRIME) & _MASK)
                keys.append(key)
                node = 0
        self.node = node

    def mark(self) -> tuple[int, int]:
        return len(self.keys), self.node

    def back(self, mark: tuple[int, int]) -> None:
        size, self.node = mark
        for key in self.keys[size:]:
            del self.known[key]
        del self.keys[size:], self.hashes[size + 1 :]

    def fingerprint(self) -> np.ndarray:
        h = np.array(self.hashes[1:], dtype=np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = np.unique((h >> np.uint64(32)).astype(np.uint32)) if len(h) <= 2 * SIZE else _least((h >> np.uint64(32)).astype(np.uint32))
        return h[:SIZE]


def _least(h: np.ndarray) -> np.ndarray:
    """The SIZE least distinct values and perhaps some more, ascending."""
    at = 2 * SIZE
    while len(low := np.unique(np.partition(h, at - 1)[:at])) < SIZE and at < len(h):
        at = min(2 * at, len(h))
    return low


def fingerprint(text: str) -> np.ndarray:
    parse = Parse()
    parse.add(text.encode())
    return parse.fingerprint()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard coefficient of the sets behind two fingerprints; 1 for two empty ones, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    if max(len(a), len(b)) >= SIZE:
        both = both[:SIZE]
    return float((np.isin(both, a) & np.isin(both, b)).sum() / len(both))


def _text(h: np.ndarray) -> str:
    return h.astype(">u4").tobytes().hex()


def _hashes(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def fingerprints(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``fingerprint`` of every row; null texts are empty, empty texts have an empty fingerprint."""
    small_batches(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"key": frame["key"], "fingerprint": [_text(fingerprint(t)) for t in frame["text"]]})

    found = rows.select(F.col(key).cast("string").alias("key"), whole(text).alias("text")).mapInPandas(lean(run), "key string, fingerprint string")
    return found.select(F.col("key").cast(rows.schema[key].dataType).alias(key), "fingerprint")


class _Edits:
    """A text, parsed, and its edited one: the last third gives way to the beginning of the text behind it."""

    def __init__(self, key: str | None, text: str):
        self.key, self.text, self.parse = key, text, Parse()
        n = len(text)
        self.third = n // 3
        self.kept = text[: n - self.third]
        self.parse.add(self.kept.encode())
        self.at = self.parse.mark()
        self.parse.add(text[n - self.third :].encode())
        self.own = self.parse.fingerprint()

    def row(self, beside: str, theirs: np.ndarray) -> tuple:
        tail = beside[: self.third]
        self.parse.back(self.at)
        self.parse.add(tail.encode())
        new = self.parse.fingerprint()
        return (self.key, len(self.text), hashlib.sha256((self.kept + tail).encode()).hexdigest(), _text(self.own), _text(new), likeness(self.own, new), likeness(self.own, theirs))


_ROW = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = "key string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _bucket(bounds: list[int]):
    """(key, hash) -> number of the bucket, ascending in both; ``bounds``: ascending, a bound that is there n times splits its key's rows into n buckets by hash."""
    values, many = np.unique(np.array(bounds, dtype=np.int64), return_counts=True)
    begins = np.concatenate([[0], np.cumsum(many)])

    def of(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(values, keys)
        own = np.minimum(at, len(values) - 1)
        part = ((hashes >> 33) + (1 << 30)) * many[own] >> 31  # of the hash's 31 upper bits
        return begins[at] + np.where(values[own] == keys, part, 0)

    return of


def _bucketed(rows: DataFrame, tasks: int) -> DataFrame:
    """``rows`` (place, text, ...) with hash and bucket; rows without place come before all others, in buckets of their own."""
    told = rows.agg(F.count("*").alias("n"), F.count("place").alias("known"), F.percentile_approx("place", [i / tasks for i in range(1, tasks)] or [0.5], 100 * tasks).alias("bounds")).first()
    none = -(-tasks * (told["n"] - told["known"]) // max(1, told["n"]))
    of = _bucket(sorted(told["bounds"])) if told["known"] else None

    @F.pandas_udf("long")
    def bucket(place: pd.Series, hashed: pd.Series) -> pd.Series:
        h = hashed.to_numpy(dtype=np.int64)
        return pd.Series(none + of(place.to_numpy(dtype=np.int64), h))

    rows = rows.withColumn("hash", F.xxhash64("text"))
    null = F.shiftright((F.shiftright("hash", 33) + (1 << 30)) * F.lit(none).cast("long"), 31)
    return rows.withColumn("bucket", F.when(F.col("place").isNull(), null).otherwise(bucket(F.coalesce("place", F.lit(0)), "hash")) if of else null)


def edited(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` (integers), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next row is the one behind in descending order of ``key`` (nulls last; repeated keys by the text's hash,
    descending, then the text), behind the last the first, which may be the row itself. The edited text has the last
    third (rounded down) of the code points replaced by as many first ones of the next row's text, or all it has.
    Null texts are empty. No rows give none; other columns don't matter.
    """
    spark = rows.sparkSession
    small_batches(spark)
    tasks = partitions(spark)
    own = _bucketed(rows.select(F.col(key).cast("long").alias("place"), whole(text).alias("text")), tasks)
    # the first row of each bucket, no more than twice the tasks: sent to the bucket before, too
    heads = own.groupBy("bucket").agg(F.max(F.struct("place", "hash")).alias("head")).select("bucket", "head.*").orderBy(F.desc("bucket")).collect()
    back = [(h["bucket"], h["place"], h["hash"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)]
    back = spark.createDataFrame(back, "b long, p long, h long, back long")
    dealt = own.join(F.broadcast(back), (F.col("bucket") == F.col("b")) & F.col("place").eqNullSafe(F.col("p")) & (F.col("hash") == F.col("h")), "left")
    to = lambda bucket, copy: F.struct(bucket.alias("bucket"), F.lit(copy).alias("copy"))
    dealt = dealt.select("place", "hash", "text", F.explode(F.when(F.col("back").isNull(), F.array(to(F.col("bucket"), False))).otherwise(F.array(to(F.col("bucket"), False), to(F.col("back"), True)))).alias("to"))
    order = [F.desc("bucket"), F.col("copy"), F.desc_nulls_last("place"), F.desc("hash"), F.col("text")]
    dealt = dealt.select("to.*", "place", "hash", "text").repartitionByRange(tasks, F.desc("bucket")).sortWithinPartitions(*order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = None, None
        for frame in frames:
            out = []
            for bucket, copy, key_, text_ in frame.itertuples(index=False, name=None):
                if copy and now != bucket:
                    continue  # the bucket before was finished by a first copy
                this = _Edits(key_, text_)
                if now == bucket:
                    out.append(held.row(text_, this.own))
                held, now = (None, None) if copy else (this, bucket)
            yield pd.DataFrame(out, columns=_ROW, dtype=object)

    done = dealt.select("bucket", "copy", F.col("place").cast("string").alias("key"), "text").mapInPandas(lean(run), _TYPES)
    return done.select(F.col("key").cast(rows.schema[key].dataType).alias(key), *_ROW[1:])
