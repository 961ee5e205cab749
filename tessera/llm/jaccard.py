"""Exact n-gram Jaccard join with set-relation skipping, and its components.

A document's set holds the hashes (64 bits) of its distinct word n-grams; two sets
link when 100 * intersection >= percent * union. Documents with equal sets are one
class, so copies are never compared.

*Order.* All sets are ordered alike: rare n-grams first, the most frequent ones of
the corpus (a bounded table, counted over all documents) last, by count. Only the
counts of that table matter for speed; any common order gives the same links.

*Index.* Two linked sets share an n-gram in their prefixes, so only prefixes are
indexed. In a list of at most ``SHORT_LIST`` sets, pairs are kept whose sizes are in
range and whose positions leave enough n-grams after them. A longer list, as a group
of near copies has them, is streamed: its least set leads it, and every other set
joins the leader's group. Lists of similar sets have the same leader, so a set is in
few groups.

*Answers from similar sets.* A group is compared in tasks of bounded size: by
classes of set size, of which neighbours alone can link, and within these by chunks,
so blocks of sets beyond the size range are skipped whole. In a task the sets of two
neighbouring classes are compared by a leader of their own: its overlap with each is
counted, sets so close to it that they must link to each other are answered by it,
and the overlaps of all others are derived from the leader's and from the n-grams
in which two sets differ from it. What leaves a task is a spanning star of each group
that links, so a group of near copies makes as many rows as it has members.

*Outlines.* In a large corpus n-grams outside the bounded table are in lists of sets
that share little else. So tasks are first dealt outlines instead of sets: counts of
n-grams by ranges of hashes, an n-gram's 16 or 8 a range and one byte each. Two sets
differ by as many n-grams as their outlines do at least; a set of which no outline in
a task is near enough has no link there, and isn't sent.

What is moved: packed counts (some three bytes an n-gram), prefix rows, outlines of
sets in lists, and the sets of documents that may link by their outlines, once for each
task that compares them. Texts are moved only of such documents, told by a map of bits,
and where there are few not at all.

Null texts, empty texts and texts of white space alone have empty sets and link
with nothing; with fewer words than n the whole sequence is the one n-gram. Ties in
the orders go by hash, then class. Repeated rows are documents of one class; a
component's id ignores null ids. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import checkpointed, lean, partitions, small_batches, whole
from tessera.llm.collocations import BITS, _mixed, _told, bit_map
from tessera.llm.components import components

#: The most n-grams whose counts order the sets, and the least count of one: 16 bytes each are sent to every executor.
FREQUENT, LEAST_COUNT = 1_000_000, 5
#: Bits of a hash that are counted: n-grams that agree in them share a count, which only the order feels.
COUNTED_BITS = 44
#: Of lists up to this length pairs are taken.
SHORT_LIST = 12
#: Sets, and n-grams of all of them, in a chunk of a group: a task compares two chunks or three.
GROUP, GROUP_GRAMS = 1_000, 1_000_000
#: Up to so many bytes of keys of documents with a candidate are sent to the texts; beyond, their texts and keys are joined by a shuffle.
BROADCAST_ROUTES = 8_000_000
#: Hashes a counting task holds before it writes them out.
BUFFER = 1_000_000
#: Columns of a group's matrix that are multiplied at once.
COLUMNS = 4_096

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype="u8")


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams: A-Z lower-cased, words between ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype="u8")
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype="u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype="u8", count=len(words))
    out = np.zeros(len(words) - n + 1, dtype="u8")
    for k in range(n):
        x = h[k : k + len(out)] * MIX[k % len(MIX)] + np.uint64(k)
        out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def class_key(found: np.ndarray) -> int:
    """Names a class of equal sets."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def _bits(size: int) -> int:
    return max(4, size.bit_length() - 4)


def outline(found: np.ndarray) -> bytes | None:
    """Counts of the hashes by as many equal ranges as a power of two says, which goes with the set's size; none where a byte is too small."""
    bits = _bits(len(found))
    counts = np.bincount((found >> np.uint64(64 - bits)).astype("i8"), minlength=1 << bits)
    return counts.astype("u1").tobytes() if counts.max() < 256 else None


def may_link(sizes: np.ndarray, outlines, percent: int) -> np.ndarray:
    """Whether a set may link with any other, as far as sizes and outlines tell; every set that links is told."""
    if len(sizes) < 2:
        return np.zeros(len(sizes), dtype=bool)
    by = np.argsort(sizes, kind="stable")
    n, lines = sizes[by].astype("i8"), [outlines[i] for i in by]
    told, unknown = np.zeros(len(by), dtype=bool), np.array([x is None for x in lines])
    widths = [1 << _bits(int(x)) for x in n]
    ends = np.searchsorted(n, 100 * n // percent, "right")
    width = 0
    for i, end in enumerate(ends):
        others = np.arange(i + 1, end)
        if told[i]:
            others = others[~told[others]]
        if not len(others):
            continue
        if widths[i] != width:  # the sets from here to the largest that one of this width can link with, all in ranges of this width
            first, width = i, widths[i]
            last = ends[i + widths[i:].count(width) - 1]
            lined = np.stack([np.zeros(width, "i4") if x is None else np.frombuffer(x, "u1").reshape(width, -1).sum(axis=1, dtype="i4") for x in lines[first:last]])
        apart = np.abs(lined[others - first] - lined[i - first]).sum(axis=1)
        both = n[others] + n[i]
        near = ((both - apart) // 2 >= least_overlap(both, percent)) | unknown[others] | unknown[i]
        told[others[near]] = True
        told[i] |= near.any()
    out = np.zeros(len(by), dtype=bool)
    out[by] = told
    return out


def least_overlap(sizes, percent: int):
    """The least intersection of two sets, from the sum of their sizes."""
    return -(-percent * sizes // (100 + percent))


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    common = _common(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


SEEN = "name string, n long, key long, outline binary, part int, counts binary"


def _seen(n: int, parts: int):
    """A row a document, (name, n, key, outline), and rows of packed counted hashes by part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def counted() -> pd.DataFrame:
            values = np.sort(np.concatenate(held) >> np.uint64(64 - COUNTED_BITS))
            part = (values * np.uint64(parts)) >> np.uint64(COUNTED_BITS) if parts < 2 ** (63 - COUNTED_BITS) else values % np.uint64(parts)
            ends = np.searchsorted(part, np.arange(parts + 1, dtype="u8"))
            pack = zstandard.ZstdCompressor(level=1)
            rows = [(p, pack.compress(_deltas(values[ends[p] : ends[p + 1]]))) for p in range(parts) if ends[p] < ends[p + 1]]
            return _frame([(None, None, None, None, p, b) for p, b in rows])

        for frame in frames:
            rows = []
            for doc, text in zip(frame["name"], frame["text"], strict=True):
                found = shingles(text, n)
                rows.append((doc, len(found), class_key(found) if len(found) else None, outline(found) if len(found) else None, None, None))
                held.append(found)
                size += len(found)
                if size >= BUFFER:
                    yield counted()
                    held, size = [], 0
            yield _frame(rows)
        if size:
            yield counted()

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        doc, size, key, line, part, counts = zip(*rows, strict=True) if rows else ((),) * 6
        whole_number = lambda x: None if x is None or x != x else int(x)
        # ids come and go as text, and nullable integers are made from Python's own: through floats both would lose their last bits
        whole_numbers = {c: pd.array([whole_number(x) for x in v], dtype=kind) for c, v, kind in (("n", size, "Int64"), ("key", key, "Int64"), ("part", part, "Int32"))}
        objects = {c: pd.Series(v, dtype=object) for c, v in (("name", doc), ("outline", line), ("counts", counts))}
        return pd.DataFrame(objects | whole_numbers)[["name", "n", "key", "outline", "part", "counts"]]

    return run


def _deltas(values: np.ndarray) -> bytes:
    """Sorted values as first value and gaps; the first byte tells the width."""
    gaps = np.diff(values, prepend=np.uint64(0))
    small = gaps[1:].max(initial=0) < 2**32
    return bytes([4 if small else 8]) + gaps[:1].astype("<u8").tobytes() + gaps[1:].astype("<u4" if small else "<u8").tobytes()


def _undeltas(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, dtype="<u8", count=1, offset=1)
    return np.cumsum(np.concatenate([first, np.frombuffer(data, dtype=f"<u{data[0]}", offset=9).astype("u8")]))


def _frequent(frame: pd.DataFrame) -> pd.DataFrame:
    unpack = zstandard.ZstdDecompressor()
    values, counts = np.unique(np.concatenate([_undeltas(unpack.decompress(b)) for b in frame["counts"]]), return_counts=True)
    often = counts >= LEAST_COUNT
    return pd.DataFrame({"value": values[often].astype("i8"), "count": counts[often]})


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"values": [frame["value"].to_numpy("<i8").tobytes()], "counts": [frame["count"].to_numpy("<i8").tobytes()]})


def _top(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of the greatest counts, sorted, and their counts: those from the least count on above which there are at most ``most``."""
    least, n = None, 0
    for row in counts.groupBy("count").agg(F.count("*").alias("k")).orderBy(F.desc("count")).limit(100_000).toLocalIterator():
        n += row["k"]
        if n > most:
            break
        least = row["count"]
    if least is None:
        return np.empty(0, dtype="u8"), np.empty(0, dtype="i8")
    rows = counts.filter(F.col("count") >= least).mapInPandas(_packed, "values binary, counts binary").collect()
    values = np.concatenate([np.frombuffer(r["values"], dtype="<i8") for r in rows]).astype("u8")
    by = np.argsort(values)
    return values[by], np.concatenate([np.frombuffer(r["counts"], dtype="<i8") for r in rows])[by]


POSTING = "h long, n int, pos int, key long"


def _postings(n: int, percent: int, frequent):
    """Prefix rows, of equal sets in a task only the first's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, counts = frequent.value
        met: set[int] = set()
        for frame in frames:
            out, rows = [], 0
            for text in frame["text"]:
                found = shingles(text, n)
                size = len(found)
                if not size or (key := class_key(found)) in met:
                    continue
                met.add(key)
                rank = np.zeros(size, dtype="i8")
                if len(values):
                    counted = found >> np.uint64(64 - COUNTED_BITS)
                    at = np.searchsorted(values, counted)
                    at[at == len(values)] = 0
                    rank = np.where(values[at] == counted, counts[at], 0)
                prefix = size - -(-percent * size // 100) + 1
                first = found[np.argsort(rank, kind="stable")[:prefix]]
                out.append((first.view("i8"), np.full(prefix, size, dtype="i4"), np.arange(prefix, dtype="i4"), np.full(prefix, key, dtype="i8")))
                rows += prefix
                if rows > 200_000:
                    yield made(out)
                    out, rows = [], 0
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("h", "n", "pos", "key"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


LISTED = "leader long, key long"


def _lists(percent: int):
    """Rows (leader, key) of sets to compare, from postings sorted by (h, key); one long list is never held."""

    def listed(h: np.ndarray, key: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
        starts = np.nonzero(np.diff(h, prepend=h[:1] - 1) != 0)[0]
        sizes = np.diff(np.append(starts, len(h)))
        long = np.repeat(sizes > SHORT_LIST, sizes)
        found = [np.stack([np.repeat(key[starts], sizes)[long], key[long]], axis=1)]
        for step in range(1, SHORT_LIST):
            i = np.nonzero((h[step:] == h[:-step]) & ~long[:-step])[0]
            if not len(i):
                break
            j = i + step
            need = least_overlap(n[i].astype("i8") + n[j], percent)
            near = 100 * np.minimum(n[i], n[j]).astype("i8") >= percent * np.maximum(n[i], n[j]).astype("i8")
            near &= (n[i] - pos[i] >= need) & (n[j] - pos[j] >= need)
            found.append(np.stack([key[i], key[j]], axis=1)[near])
        rows = np.concatenate(found)
        return pd.DataFrame({"leader": rows[:, 0], "key": rows[:, 1]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, going = None, None  # rows of a list that may go on; hash and leader of a long list whose rows go straight on
        for frame in frames:
            rows = [frame[c].to_numpy() for c in ("h", "key", "n", "pos")]
            if going is not None:
                end = int(np.searchsorted(rows[0], going[0], "right"))
                if end:
                    yield pd.DataFrame({"leader": going[1], "key": rows[1][:end]})
                if end == len(rows[0]):
                    continue
                going, rows = None, [c[end:] for c in rows]
            if tail is not None:
                rows = [np.concatenate(c) for c in zip(tail, rows, strict=True)]
            if not len(rows[0]):
                continue
            # a class may come from several tasks
            fresh = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
            rows = [c[fresh] for c in rows]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            tail = [c[cut:] for c in rows]
            if cut:
                yield listed(*(c[:cut] for c in rows))
            if len(tail[0]) > SHORT_LIST:
                going = (tail[0][0], tail[1][0])
                yield pd.DataFrame({"leader": going[1], "key": tail[1]})
                tail = None
        if tail is not None:
            yield listed(*tail)

    return run


def _overlaps(sets: list[np.ndarray], rest: np.ndarray, lead: int, common: np.ndarray) -> np.ndarray:
    """Intersection sizes of the sets ``rest`` with all, from each set's overlap with the leader and the n-grams in which sets differ from it."""
    own, m = sets[lead], len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(x) for x in sets])
    at = np.searchsorted(own, flat)
    at[at == len(own)] = 0
    shared = own[at] == flat
    has = np.zeros((m, len(own)), dtype=bool)
    has[owner[shared], at[shared]] = True
    lacks, place = np.nonzero(~has)
    _, more, times = np.unique(flat[~shared], return_inverse=True, return_counts=True)
    twice = times[more] > 1  # an n-gram of one set alone is in no intersection
    row = np.concatenate([lacks, owner[~shared][twice]])
    col = np.concatenate([place, len(own) + more[twice]])
    missing = len(own) - common
    out = (len(own) - missing[rest][:, None] - missing[None, :]).astype("f8")
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    # columns anew, without gaps
    col = np.cumsum(np.diff(col, prepend=col[:1]) != 0)
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        some = slice(*np.searchsorted(col, [start, start + COLUMNS]))
        part = np.zeros((m, min(COLUMNS, int(col[-1]) + 1 - start)), dtype="f4")
        part[row[some], col[some] - start] = 1
        out += part[rest] @ part.T
    return out


def grouped(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set a number that sets connected by links share."""
    m = len(sets)
    if m == 2:
        return np.array([0, 0 if links(*sets, percent) else 1])
    label = np.arange(m)

    def join(members: np.ndarray) -> None:
        roots = np.unique(label[members])
        if len(roots) > 1:
            label[np.isin(label, roots[1:])] = roots[0]

    size = np.array([len(x) for x in sets])
    kind = _size_class(size, percent)
    classes = np.unique(kind)
    for c in classes:
        if c + 1 not in classes and c - 1 in classes:
            continue  # compared with the class below
        window = np.nonzero((kind == c) | (kind == c + 1))[0]
        if len(window) < 2:
            continue
        window = window[np.argsort(size[window], kind="stable")]
        chosen, n = [sets[i] for i in window], size[window]
        own = chosen[0]
        common = np.array([_common(own, x) for x in chosen])
        union = n + len(own) - common
        close = 200 * common >= (100 + percent) * union
        join(window[100 * common >= percent * union])
        rest = np.nonzero(~close)[0]
        if not len(rest):
            continue
        both = _overlaps(chosen, rest, 0, common)
        linked = 100 * both >= percent * (n[rest][:, None] + n[None, :] - both)
        for i, row in zip(rest, linked, strict=True):
            row[i] = True
            join(window[row])
    return label


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The intersection's size of two sorted sets, of which a is the smaller."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _step(percent: int) -> float:
    """Logarithm of the ratio of size classes: a little more than sets that link can differ by."""
    return math.log(100 / percent) * (1 + 1e-6)


def _size_class(size: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(size) / _step(percent)).astype("i8")


ROUTED = "name string, key long, leader long, block long"


def _near(percent: int):
    """Of the sets of each task (leader, block), by which rows are sorted, those that may link in it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def kept(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            sizes, lines = rows["n"].to_numpy(), rows["outline"].to_numpy()
            told = np.zeros(len(rows), dtype=bool)
            for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
                told[a:b] = may_link(sizes[a:b], lines[a:b], percent)
            return rows.loc[told, ["name", "key", "leader", "block"]]

        tail = None  # rows of a task that may go on
        for frame in frames:
            if tail is not None:
                frame = pd.concat([tail, frame], ignore_index=True)
            if not len(frame):
                continue
            lead, block = frame["leader"].to_numpy(), frame["block"].to_numpy()
            starts = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (block[1:] != block[:-1])])
            tail = frame[starts[-1] :]
            if len(starts) > 1:
                yield kept(frame[: starts[-1]], starts[:-1])
        if tail is not None:
            yield kept(tail, np.array([0]))

    return run


def _dealt(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(name, key, routes): for each set the tasks (leader, block) that compare it."""
    members = groups.union(groups.select("leader", F.col("leader").alias("key"))).distinct()
    members = checkpointed(members.join(classes.drop("rep"), "key").withColumn("kind", F.floor(F.log("n") / F.lit(_step(percent))).cast("long")))
    sizes = members.groupBy("leader", "kind").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    chunks = F.ceil(F.greatest(F.col("rows") / GROUP, F.col("grams") / GROUP_GRAMS))
    large = sizes.withColumn("chunks", chunks).groupBy("leader").agg(F.map_from_entries(F.collect_list(F.struct("kind", "chunks"))).alias("chunks"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"))
    large = large.filter((F.col("rows") > GROUP) | (F.col("grams") > GROUP_GRAMS)).select("leader", "chunks")
    many = lambda kind: F.coalesce(F.try_element_at("chunks", kind), F.lit(0))
    chunk = lambda kind, k: kind * F.lit(2**32) + k
    own = chunk(F.col("kind"), F.pmod(F.xxhash64("key"), many(F.col("kind"))))
    near = F.flatten(F.transform(F.array(*[F.col("kind") + d for d in (-1, 0, 1)]), lambda kind: F.transform(F.when(many(kind) > 0, F.sequence(F.lit(0).cast("long"), many(kind) - 1)).otherwise(F.array().cast("array<bigint>")), lambda k: chunk(kind, k))))
    blocks = F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(near, lambda other: F.xxhash64(F.least(own, other), F.greatest(own, other))))
    placed = members.join(large, "leader", "left").select("name", "key", "n", "outline", "leader", F.explode(blocks).alias("block"))
    placed = placed.repartition(partitions(groups.sparkSession), "leader", "block").sortWithinPartitions("leader", "block").mapInPandas(lean(_near(percent)), ROUTED)
    # a set is in as many groups as its prefix has n-grams at most
    return checkpointed(placed.groupBy("name", "key").agg(F.collect_list(F.struct("leader", "block")).alias("routes")))


def _named(documents: DataFrame, routes: DataFrame, room: int = BITS) -> DataFrame:
    """Rows whose name ``routes`` has, and those few that a map of ``room`` bits takes for such."""
    hashed = F.xxhash64("name").alias("hash")
    known = documents.sparkSession.sparkContext.broadcast(bit_map(routes.select(hashed), ["hash"], room))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = known.value
        for frame in frames:
            yield frame.loc[_told(bits, _mixed([frame["hash"].to_numpy()], room)), ["name", "text"]]

    return documents.select("name", "text", hashed).mapInPandas(lean(run), "name string, text string")


def _verified(documents: DataFrame, routes: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs of class keys (a, b): spanning stars of what links in each task. Only documents with a candidate make their sets anew."""
    bytes_ = routes.agg(F.sum(F.size("routes") * 32 + 64)).first()[0] or 0
    if bytes_ <= BROADCAST_ROUTES:
        routes = F.broadcast(routes)
    else:
        documents, routes = _named(documents, routes), routes.hint("shuffle_hash")  # so texts aren't sorted
    texts = documents.join(routes, "name").select("text", "key", "routes")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for text, key, to in zip(frame["text"], frame["key"], frame["routes"], strict=True):
                found = shingles(text, n)
                if not len(found) or class_key(found) != key:  # names may repeat with other texts
                    continue
                data = found.tobytes()
                for r in to:
                    rows.append((r["leader"], r["block"], key, data))
                    held += len(data)
                    if held > 32_000_000:
                        yield pd.DataFrame(rows, columns=["leader", "block", "key", "found"])
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=["leader", "block", "key", "found"])

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = None, {}

        def done() -> tuple[np.ndarray, np.ndarray]:
            keys = np.array(list(held), dtype="i8")
            if len(keys) < 2:
                return keys[:0], keys[:0]
            label = grouped(list(held.values()), percent)
            other = np.nonzero(label != np.arange(len(keys)))[0]
            return keys[label[other]], keys[other]

        for frame in frames:
            out = []
            for lead, block, key, data in zip(frame["leader"], frame["block"], frame["key"], frame["found"], strict=True):
                if (lead, block) != group:
                    out.append(done())
                    group, held = (lead, block), {}
                held[key] = np.frombuffer(data, dtype="u8")
            if out:
                a, b = map(np.concatenate, zip(*out, strict=True))
                yield pd.DataFrame({"a": a, "b": b})
        a, b = done()
        yield pd.DataFrame({"a": a, "b": b})

    k = partitions(documents.sparkSession)
    routed = texts.mapInPandas(lean(sets), "leader long, block long, key long, found binary").repartition(k, "leader", "block").sortWithinPartitions("leader", "block", "key")
    return checkpointed(routed.mapInPandas(lean(compared), "a long, b long").distinct())


def joined(documents: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """doc_id, n_shingles, component_id of every document; ids are long or string."""
    spark = documents.sparkSession
    small_batches(spark)
    documents = documents.select(F.col(id_col).cast(id_type).alias("doc_id"), whole(text_col).alias("text"))
    # what a set is fetched by: the document's id, or where it has none its text's hash
    documents = documents.select(F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("text "), F.xxhash64("text").cast("string"))).alias("name"), "text")
    own_id = F.when(F.col("name").startswith("id "), F.substr("name", F.lit(4))).cast(id_type)
    k = partitions(spark)
    seen = checkpointed(documents.mapInPandas(lean(_seen(n, 2 * k)), SEEN))
    counts = checkpointed(seen.filter("part is not null").select("part", "counts").groupBy("part").applyInPandas(_frequent, "value long, count long"))
    frequent = spark.sparkContext.broadcast(_top(counts, FREQUENT))
    own = seen.filter("part is null").select(own_id.alias("doc_id"), "name", "n", "key", "outline")
    del seen, counts  # of what counted, only short rows stay
    own = checkpointed(own)
    groups = checkpointed(documents.select("text").mapInPandas(lean(_postings(n, percent, frequent)), POSTING).repartition(k, "h").sortWithinPartitions("h", "key").mapInPandas(lean(_lists(percent)), LISTED).distinct())
    classes = checkpointed(own.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("name").alias("name"), F.first("n").alias("n"), F.first("outline").alias("outline")))
    found = _verified(documents, _dealt(groups, classes, percent), n, percent)
    named = components(found).withColumnRenamed("node", "key").withColumnRenamed("component", "part")
    least = classes.join(named, "key").groupBy("part").agg(F.min("rep").alias("least"))
    result = classes.join(named, "key", "left").join(least, "part", "left").select("key", F.coalesce("least", "rep").alias("component_id"))
    return own.drop("name", "outline").join(result, "key", "left").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
