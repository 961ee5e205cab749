"""Collocations: frequent phrases that hold together, from inverted lists of word positions.

Texts are cut into pieces and these into words; every word has a place in its block (some
two million places of one language), and between two pieces one place stays free. The
vertical index has for each word of a block the ascending list of its places. A phrase's list
comes from merging: the places of its first words, of which one further stands the list of
its last ones. The length of a phrase's lists over all blocks is its exact frequency.

A phrase can only be frequent if the phrases without its last and without its first word
are, so the lists of those are merged alone. Which they are tells a map of BITS bits, sent
to all tasks; it may let a rare phrase through, which is then counted and dropped, so counts
and results are exact, whatever the map's size. Counts are summed in the tasks and packed
before they are shuffled.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import checkpointed, forgotten, lean, partitions, small_batches, whole, written

#: Places of a block; a longer text makes a longer block.
PLACES = 1 << 21
#: Bits of the map of frequent phrases (8 MB).
BITS = 1 << 26
#: Phrases of blocks that a task holds before it counts and packs them.
HELD = 1_000_000
#: Rows of a language are ranked in so many parts before the whole.
PARTS = 32

_CUTS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_CUTS + b"\t" + bytes(range(65, 91)), b"\n" * len(_CUTS) + b" " + bytes(range(97, 123)))


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class _Lists:
    """The words of one language's block, in the order of their places."""

    def __init__(self):
        self.codes, self.at = _Codes(), array("i")

    def add(self, text: str) -> int:
        """Places that the text takes."""
        before = len(self.at)
        code = self.codes.__getitem__
        for piece in text.encode().translate(_PLAIN).split(b"\n"):
            if words := piece.split():
                self.at.extend(map(code, words))
                self.at.append(-1)
        return len(self.at) - before

    def batch(self, lang: str, block: int) -> pa.RecordBatch:
        at = np.frombuffer(self.at, dtype=np.int32)
        places = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :].astype("<i4")
        counts = np.bincount(at[at >= 0], minlength=len(self.codes)).astype(np.int32)
        words = pa.array(list(self.codes), pa.binary()).cast(pa.string())
        ends = pa.array([0, len(words)], pa.int32())
        columns = {"lang": pa.array([lang], pa.string()), "block": pa.array([block], pa.int64()), "words": pa.ListArray.from_arrays(ends, words), "counts": pa.ListArray.from_arrays(ends, pa.array(counts)), "places": pa.array([places.tobytes()], pa.binary())}
        return pa.record_batch(list(columns.values()), names=list(columns))


def postings(texts: DataFrame, size: int = PLACES) -> DataFrame:
    """(lang, block, words, counts, places) of (lang, text), a row a block of one language: its words, their lists' lengths, and the lists one after the other, ascending 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists, held = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held += lists.setdefault(lang, _Lists()).add(text)
                if held >= size:
                    yield from (own.batch(k, block + i) for i, (k, own) in enumerate(lists.items()))
                    block, lists, held = block + len(lists), {}, 0
        yield from (own.batch(k, block + i) for i, (k, own) in enumerate(lists.items()))

    return texts.mapInArrow(lean(run), "lang string, block long, words array<string>, counts array<int>, places binary")


def _mixed(keys: list[np.ndarray], room: int) -> np.ndarray:
    """A place in the map of bits for each phrase, whose words' numbers are ``keys``."""
    h = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        h = (h ^ key.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.int64) % room


def bit_map(phrases: DataFrame, names: list[str], room: int = BITS) -> np.ndarray:
    """The map of the columns ``names``: ``room`` bits (a multiple of 2 ** 15), collected in parts."""

    def places(frames):
        for frame in frames:
            at = np.unique(_mixed([frame[n].to_numpy() for n in names], room))
            yield pd.DataFrame({"part": at >> 15, "bit": at & 0x7FFF})

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 15, bool)
        bits[frame["bit"].to_numpy()] = True
        return pd.DataFrame({"part": [int(frame["part"].iloc[0])], "bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((room >> 15, 1 << 12), np.uint8)
    bits = phrases.select(*names).mapInPandas(places, "part long, bit long").distinct().groupBy("part").applyInPandas(part, "part long, bits binary")
    for row in bits.collect():
        out[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.ravel()


def _told(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _merge(first: np.ndarray, second: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the ascending lists a place of ``first`` has one of ``second`` ``apart`` places on."""
    at = np.searchsorted(second, first + apart)
    at[at == len(second)] = 0
    hit = second[at] == first + apart if len(second) else np.zeros(len(first), bool)
    return np.flatnonzero(hit), at[hit]


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of phrases (their words' numbers, then how often found) in ascending order, equal phrases as one."""
    order = np.lexsort(columns[-2::-1])
    *keys, found = (c[order] for c in columns)
    starts = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))[: len(found)]
    return [k[starts] for k in keys] + [np.add.reduceat(found, starts) if len(found) else found]


def _pack(columns: list[np.ndarray]) -> bytes:
    """Ascending rows as differences from row to row, byte by byte of all, compressed: some four bytes a pair of words."""
    steps = np.stack([np.diff(c, prepend=0) for c in columns])
    if not len(steps[0]) or np.abs(steps).max() < 2**31:
        steps = steps.astype("<i4")
    width = steps.itemsize
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(steps.view("u1").reshape(-1, width).T.tobytes())


def _unpack(data: bytes, columns: int) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "u1").reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<i{width}").reshape(columns, -1).astype("i8"), axis=1)


def _packs(columns: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """(part, packed): phrases by a hash of their words."""
    columns = _summed(columns)
    part = _mixed(columns[:-1], parts)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    own = [(p, _pack([c[ends[p] : ends[p + 1]] for c in columns])) for p in range(parts) if ends[p] < ends[p + 1]]
    return pa.record_batch([pa.array([p for p, _ in own], pa.int32()), pa.array([b for _, b in own], pa.binary())], names=["part", "packed"])


def counted(packs: DataFrame, size: int, least: int) -> DataFrame:
    """(w1 ... w``size``, a) of all blocks' packed phrases: those found ``least`` times or more."""
    names = [f"w{i + 1}" for i in range(size)]

    def run(part: pa.Table) -> pa.Table:
        columns = _summed(list(np.concatenate([_unpack(b, size + 1) for b in part["packed"].to_pylist()], axis=1)))
        often = columns[-1] >= least
        return pa.table([pa.array(c[often]) for c in columns], names=[*names, "a"])

    return packs.groupBy("part").applyInArrow(run, ", ".join(f"{n} long" for n in names) + ", a long")


def extended(index: DataFrame, size: int, maps: list, parts: int) -> DataFrame:
    """(part, packed) of each task: phrases whose two parts of one word less may be frequent, counted and packed by ``parts``; maps: of 2 words up to size - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for ids, counts, places in zip(*(batch[c] for c in ("ids", "counts", "places")), strict=True):
                ids, counts, places = (np.frombuffer(x.as_py(), t) for x, t in ((ids, "<i8"), (counts, "<i4"), (places, "<i4")))
                order = np.argsort(places, kind="stable")
                here = places[order]
                keys = [np.repeat(np.arange(len(ids), dtype=np.int32), counts)[order]]  # words by their number in the block
                del order, places
                for n in range(2, size + 1):
                    # the places of phrases of n - 1 words, and one on from each those of its last n - 1 words
                    a, b = _merge(here, here, 1)
                    keys, here = [k[a] for k in keys] + [keys[-1][b]], here[a]
                    if n < size:
                        bits = maps[n - 2].value
                        kept = _told(bits, _mixed([ids[k] for k in keys], 8 * len(bits)))
                        keys, here = [k[kept] for k in keys], here[kept]
                if not len(here):
                    continue
                order = np.lexsort(keys) if len(ids) ** size >= 2**63 else np.argsort(sum(k.astype(np.int64) * len(ids) ** i for i, k in enumerate(keys)))
                keys = [k[order] for k in keys]
                starts = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
                found = np.diff(np.append(starts, len(here)))
                held.append([*(ids[k[starts]] for k in keys), found.astype("i8")])
                rows += len(starts)
                if rows >= HELD:
                    yield _packs([np.concatenate(c) for c in zip(*held, strict=True)], parts)
                    held, rows = [], 0
        if held:
            yield _packs([np.concatenate(c) for c in zip(*held, strict=True)], parts)

    return index.mapInArrow(lean(run), "part int, packed binary")


def _numbers(frame: pa.Table) -> pa.Table:
    """One row of a block: which of its words are frequent, and their numbers."""
    codes, ids = (np.asarray(frame[c].combine_chunks()) for c in ("code", "id"))
    order = np.argsort(codes)
    return pa.table({"block": frame["block"][:1], "codes": pa.array([codes[order].astype("<i4").tobytes()], pa.binary()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary())})


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the lists of their frequent words alone."""
    for batch in batches:
        for ids, codes, counts, places in zip(*(batch[c] for c in ("ids", "codes", "counts", "places")), strict=True):
            counts, codes = np.asarray(counts.values), np.frombuffer(codes.as_py(), "<i4")
            known = np.zeros(len(counts), bool)
            known[codes] = True
            kept = np.frombuffer(places.as_py(), "<i4")[np.repeat(known, counts)]
            rows = {"ids": ids.as_py(), "counts": counts[codes].astype("<i4").tobytes(), "places": kept.tobytes()}
            yield pa.record_batch([pa.array([v], pa.binary()) for v in rows.values()], names=list(rows))


def phrases(documents: DataFrame, least: int, longest: int, places: int = PLACES, room: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, id, a), (counts: ids array<long>, lang, a), (sizes: lang, n).

    words: those found ``least`` times or more in their language; counts: all phrases of 1 to ``longest`` words
    found as often, as the numbers of their words; sizes: all words of a language.
    """
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole("text").alias("text"))
    lists = written(postings(texts, places))
    sizes = checkpointed(lists.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda n, x: n + x)).alias("n")))
    own = lists.select("lang", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "list")).select("lang", "block", "code", F.col("list.words").alias("word"), F.col("list.counts").alias("found"))
    words = own.groupBy("lang", "word").agg(F.sum("found").alias("a")).filter(F.col("a") >= least)
    words = checkpointed(words.withColumn("id", F.monotonically_increasing_id()))
    tasks = (words.agg(F.max(F.shiftright("id", 33))).first()[0] or 0) + 1
    # numbers without gaps between tasks: small, so that their differences pack well
    words = words.withColumn("id", F.col("id").bitwiseAND(2**33 - 1) * tasks + F.shiftright("id", 33))
    hashed = F.xxhash64("lang", "word")
    known = spark.sparkContext.broadcast(bit_map(words.select(hashed.alias("w")), ["w"], room))

    @F.pandas_udf("boolean")
    def perhaps(h: pd.Series) -> pd.Series:
        return pd.Series(_told(known.value, _mixed([h.to_numpy()], 8 * len(known.value))))

    # most words are rare: they don't go through the join; lists stay with their block
    numbers = own.filter(perhaps(hashed)).join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "code", "id")
    numbers = numbers.groupBy("block").applyInArrow(_numbers, "block long, codes binary, ids binary")
    index = lists.select("block", "counts", "places").join(numbers, "block").select("ids", "codes", "counts", "places")
    index = written(index.mapInArrow(lean(_indexed), "ids binary, counts binary, places binary"))
    del numbers, own
    forgotten(lists)
    counts = words.select(F.array("id").alias("ids"), "lang", "a")
    langs = words.select("id", "lang")
    maps, parts = [], 2 * partitions(spark)
    for size in range(2, longest + 1):
        names = [f"w{i + 1}" for i in range(size)]
        found = checkpointed(counted(extended(index, size, list(maps), parts), size, least))
        counts = counts.union(found.join(langs, found.w1 == langs.id).select(F.array(*names), "lang", "a"))
        if size < longest:
            maps.append(spark.sparkContext.broadcast(bit_map(found, names, room)))
    return words, counts, sizes


def _exact(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def collocations(documents: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, held: int = 80, places: int = PLACES, room: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``longest`` words.

    Null texts are empty, a null language is ``und``. A candidate is found ``least`` times or more. Its score is that
    of its worst cut, floor(2000000 * a / (l + r)), ties to the shorter first part; candidates within a longer one
    that is found ``held`` percent as often or more are dropped. Ranks go by score and a descending, then the
    phrase's bytes. Products are computed in 38 digits. ``places`` of a block and ``room`` of the map don't change results. Repeated rows count each; no words, no rows.
    """
    words, counts, sizes = phrases(documents, least, longest, places, room)
    counts = checkpointed(counts)
    many = counts.filter("size(ids) > 1")
    # what a longer candidate holds: each run of two words or more, with the greatest count of those that hold it
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), k -> transform(sequence(1, size(ids) - k + 1), i -> slice(ids, i, k))))")
    within = counts.filter("size(ids) > 2").select(F.explode(inner).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    kept = many.join(within, "ids", "left").filter(F.col("longer").isNull() | (100 * _exact("longer") < held * _exact("a"))).select("ids", "lang", "a")
    cuts = kept.select("ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("left"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("right"))
    part = lambda side, name: counts.select(F.col("ids").alias(side), F.col("a").alias(name))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    cuts = cuts.withColumn("product", (2000000 * _exact("a")).cast("decimal(38,0)")).withColumn("parts", (_exact("l") + _exact("r")).cast("decimal(38,0)"))
    best = cuts.withColumn("score", F.expr("product div parts")).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the words of a phrase, as text
    spelled = best.select("ids", F.posexplode("ids").alias("i", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    ranked = best.join(spelled, "ids").select("lang", F.concat_ws(" ", "w.word").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of a language are among the best of its parts, so no task sorts all of its candidates
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
