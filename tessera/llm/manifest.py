"""Merkle manifest of a dataset, with proofs for every row.

Rows are leaves. The leaves of a partition (a source, a shard, a date) stand in order and
every run of FANOUT consecutive digests has one parent, the digest of their hexadecimal
texts one after the other; the last run of a level may be shorter, of one even, and isn't
padded. Levels are added while more than one node is left. Partitions' roots, in order of
the partition, have a tree of the same kind above them, whose root names the dataset.

Building: rows are dealt out by range of (partition, order), so each task holds consecutive
leaves, and tasks know their first leaf's place from counts of at most two partitions each.
A task pushes leaf after leaf on a stack of mountains: when the last of a run is there, the
run is carried into one node a level up, and so on. Runs that begin before the task or end
behind it aren't complete; their nodes are the edges, a few a level and task, which are
merged by blocks of SPAN levels. Memory is a few nodes a level.

Proofs: runs are dealt out in blocks of DEPTH levels, and the siblings above a block come
with it, so a task has at most FANOUT ** DEPTH leaves of a block at a time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.base import checkpointed, partitions

FANOUT = 3
#: Levels that one round of merging covers: the edges below one node of the last of these levels meet in one group.
SPAN = 6
#: Levels of a block of proofs.
DEPTH = 7


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (binary) of the values one after the other: ``-`` for null, else byte count, ``:``, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def parent(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _rising(n: Column) -> Column:
    """Levels above ``n`` leaves: the number of powers of FANOUT below n."""
    powers = [FANOUT**k for k in range(40) if FANOUT**k < 2**63]
    return sum(((n > F.lit(p).cast("long")).cast("int") for p in powers), F.lit(0))


@dataclass
class Tree:
    """``leaves`` (part, idx, digest, carried columns), ``runs`` (part, level, idx, digest, children: the digests of level - 1 in one binary), ``roots`` (part, n, digest, height)."""

    leaves: DataFrame
    runs: DataFrame
    roots: DataFrame


class _Mountains:
    """The stack of one partition's consecutive leaves; ``say`` takes (kind, level, idx, digest, children)."""

    def __init__(self, first: int, say):
        self.next, self.whole, self.say = first, first == 0, say
        self.pending: dict[int, list[tuple[int, bytes]]] = defaultdict(list)

    def push(self, level: int, idx: int, digest: bytes) -> None:
        run = self.pending[level]
        run.append((idx, digest))
        if idx % FANOUT == FANOUT - 1:
            self.carry(level)

    def carry(self, level: int) -> None:
        """The run that ends here goes one level up, or to the edges if it begins before this task."""
        run = self.pending.pop(level)
        if run[0][0] % FANOUT:
            self.edges(level, run)
            return
        digests = [d for _, d in run]
        up = parent(digests)
        self.say("run", level + 1, run[0][0] // FANOUT, up, b"".join(digests))
        self.push(level + 1, run[0][0] // FANOUT, up)

    def edges(self, level: int, run: list[tuple[int, bytes]]) -> None:
        for idx, digest in run:
            self.say("edge", level, idx, digest, None)

    def add(self, digest: bytes) -> int:
        self.push(0, self.next, digest)
        self.next += 1
        return self.next - 1

    def close(self, ends: bool) -> None:
        """``ends``: the partition's last leaf was pushed, so short runs are complete."""
        n, level = self.next, 0
        while ends and n > 1:
            if self.pending.get(level):
                self.carry(level)
            n, level = -(-n // FANOUT), level + 1
        if ends and self.whole:
            self.say("root", level, 0, self.pending.pop(level)[0][1], None)
        for level, run in self.pending.items():
            self.edges(level, run)


def tree(rows: DataFrame, part: str, order: Sequence[Column], carried: Sequence[str], tasks: int) -> Tree:
    """The tree of each value of ``part`` over ``rows``' ``digest``, in ascending ``order``, nulls first.

    Rows with equal order and digest are interchangeable. No rows: no roots.
    """
    kind = rows.schema[part].dataType.simpleString()
    extra = [(c, rows.schema[c].dataType.simpleString()) for c in carried]
    keys = [F.col(part), *[F.col(f"order {i}") for i in range(len(order))], F.col("digest")]
    ranged = rows.select(part, "digest", *carried, *[c.alias(f"order {i}") for i, c in enumerate(order)])
    ranged = ranged.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).select(part, "digest", *carried)
    ranged = checkpointed(ranged.withColumn("at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("task", F.shiftright("at", 33))
    # of each task only the first partition can have begun before, only the last can go on: two rows a task at most
    counted = ranged.groupBy(part, "task").agg(F.count("*").alias("here"))
    own = Window.partitionBy(part)
    first = F.sum("here").over(own.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    told = counted.select(part, "task", F.coalesce(first, F.lit(0)).alias("first"), (F.col("task") == F.max("task").over(own)).alias("ends"), F.sum("here").over(own).alias("n"))
    split = told.filter("first > 0 or not ends")
    told = split.select(F.col(part).alias("p"), F.col("task").alias("t"), "first", "ends")
    joined = ranged.join(F.broadcast(told), F.col(part).eqNullSafe(F.col("p")) & (F.col("task") == F.col("t")), "left")
    joined = joined.select(F.col(part), "at", "digest", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("ends", F.lit(True)).alias("ends"), *carried)
    names = ["kind", part, "level", "idx", "digest", "children", *carried]
    schema = f"kind string, `{part}` {kind}, level int, idx long, digest binary, children binary" + "".join(f", `{c}` {t}" for c, t in extra)

    def stacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        nothing = (None,) * len(carried)
        stack, now, ends, before = None, None, True, -1
        def say(what, level, idx, digest, children):
            out.append((what, now, level, idx, digest, children, *nothing))
        for frame in frames:
            frame = frame.astype(object).where(frame.notna(), None)
            for value, at, digest, first, end, *own in frame.itertuples(index=False, name=None):
                if at <= before:
                    raise RuntimeError("a task's rows aren't in their order")
                before = at
                if stack is None or value != now:
                    if stack is not None:
                        stack.close(ends)
                    now, ends = value, end
                    stack = _Mountains(int(first), say)
                idx = stack.add(bytes(digest))
                out.append(("leaf", now, 0, idx, bytes(digest), None, *own))
            yield pd.DataFrame(out, columns=names)
            out.clear()
        if stack is not None:
            stack.close(ends)
            yield pd.DataFrame(out, columns=names)

    pieces = checkpointed(joined.mapInPandas(stacked, schema))
    of = lambda what: pieces.filter(F.col("kind") == what)
    totals = counted.groupBy(part).agg(F.sum("here").alias("n"))
    most = split.agg(F.max("n")).first()[0] or 0
    runs, roots, edges = of("run"), of("root"), of("edge")
    columns = ["kind", part, "level", "idx", "digest", "children"]
    runs, roots, edges = (x.select(*columns) for x in (runs, roots, edges))
    low = 0
    while most and FANOUT**low < most:
        merged = checkpointed(_merged(edges, split.select(part, "n").distinct(), part, kind, low + SPAN))
        runs = runs.union(merged.filter("kind = 'run'"))
        roots = roots.union(merged.filter("kind = 'root'"))
        edges = edges.filter(F.col("level") > low + SPAN).union(merged.filter("kind = 'edge'"))
        low += SPAN
    p = F.col("p").eqNullSafe(F.col(part))
    roots = roots.select(F.col(part).alias("p"), "digest").join(totals, p).select(part, "n", "digest", _rising(F.col("n")).alias("height"))
    return Tree(of("leaf").select(part, "idx", "digest", *carried), runs.select(part, "level", "idx", "digest", "children"), roots)


def _merged(edges: DataFrame, split: DataFrame, part: str, kind: str, high: int) -> DataFrame:
    """Runs, roots and the edges of level ``high`` that come of the edges up to there. A group: those below one node of that level."""
    block = F.expr(f"idx div cast(power({FANOUT}, {high} - level) as long)")
    known = split.select(F.col(part).alias("p"), "n")  # partitions in more than one task: no more than tasks
    rows = edges.filter(F.col("level") <= high).join(F.broadcast(known), F.col(part).eqNullSafe(F.col("p"))).select(part, "level", "idx", "digest", "n", block.alias("block"))

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        now, n = frame[part].iloc[0], int(frame["n"].iloc[0])
        now = None if pd.isna(now) else now
        levels: dict[int, dict[int, bytes]] = defaultdict(dict)
        for level, idx, digest in zip(frame["level"], frame["idx"], frame["digest"], strict=True):
            levels[level][idx] = bytes(digest)
        out = []
        for level in range(high):
            if n == 1:
                break
            for up in sorted({i // FANOUT for i in levels[level]}):
                run = [levels[level][i] for i in range(up * FANOUT, min(up * FANOUT + FANOUT, n))]
                levels[level + 1][up] = parent(run)
                out.append(("run", now, level + 1, up, levels[level + 1][up], b"".join(run)))
            n = -(-n // FANOUT)
        else:
            level = high
        what = "root" if n == 1 else "edge"
        out += [(what, now, level, i, d, None) for i, d in levels[level].items()]
        return pd.DataFrame(out, columns=["kind", part, "level", "idx", "digest", "children"])

    return rows.groupBy(part, "block").applyInPandas(merge, f"kind string, `{part}` {kind}, level int, idx long, digest binary, children binary")


def _below(runs: list[tuple[int, int, bytes]], top: int, above: bytes) -> dict[int, dict[int, bytes]]:
    """level -> idx -> path of every node under the block's ``top``, from (level, idx, children) rows.

    A path has for each level upwards a byte of left siblings, a byte of right ones, then their digests.
    """
    paths: dict[int, dict[int, bytes]] = defaultdict(dict)
    for level, idx, children in sorted(runs, reverse=True):
        up = paths[level].get(idx, above) if level < top else above
        size = len(children) // 32
        for i in range(size):
            others = children[: 32 * i] + children[32 * i + 32 :]
            paths[level - 1][idx * FANOUT + i] = bytes([i, size - 1 - i]) + others + up
    return paths


def siblings(path: bytes) -> Iterator[tuple[str, str]]:
    """(left, right): the hexadecimal digests beside the node, level by level."""
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        middle, end = at + 2 + 32 * left, at + 2 + 32 * (left + right)
        yield path[at + 2 : middle].hex(), path[middle:end].hex()
        at = end


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    now = digest.hex()
    for left, right in siblings(path):
        now = hashlib.sha256((left + now + right).encode()).hexdigest()
    return bytes.fromhex(now)


def paths(built: Tree, part: str, above: DataFrame, leaves: DataFrame, schema: str, each) -> DataFrame:
    """Rows of ``each(leaf row, path)`` for all ``leaves``; ``above``: (part, path) that goes on behind each root.

    Block by block from the top: blocks of DEPTH levels, of which each has the path above it.
    """
    kind = built.roots.schema[part].dataType.simpleString()
    tops = built.roots.select(part, F.greatest(F.lit(0), F.expr(f"(height + {DEPTH - 1}) div {DEPTH} - 1")).cast("int").alias("chunk"), F.lit(0).cast("long").alias("block"))
    a = above.select(F.col(part).alias("p"), "path")
    tops = checkpointed(tops.join(a, F.col(part).eqNullSafe(F.col("p"))).select(part, "chunk", "block", "path"))
    highest = tops.agg(F.max("chunk")).first()[0]
    carried = [c for c in leaves.columns if c not in (part, "idx")]
    known = None
    for chunk in range(highest or 0, -1, -1):
        low, high = chunk * DEPTH, chunk * DEPTH + DEPTH
        here = tops.filter(F.col("chunk") == chunk).select(part, "block", "path")
        here = here if known is None else here.union(known)
        block = F.expr(f"idx div cast(power({FANOUT}, {high} - level) as long)")
        nulls = [F.lit(None).cast(leaves.schema[c].dataType).alias(c) for c in carried]
        rows = built.runs.filter((F.col("level") > low) & (F.col("level") <= high)).select(part, block.alias("block"), "level", "idx", F.col("children").alias("bytes"), *nulls)
        rows = rows.union(here.select(part, "block", F.lit(-1), F.lit(0).cast("long"), "path", *nulls))
        if chunk == 0:
            rows = rows.union(leaves.select(part, F.expr(f"idx div {FANOUT**DEPTH}"), F.lit(0), "idx", F.lit(None).cast("binary"), *carried))
        known = rows.groupBy(part, "block").applyInPandas(_block(low, high, part, carried, None if chunk else each), schema if chunk == 0 else f"`{part}` {kind}, block long, path binary")
    return known


def _block(low: int, high: int, part: str, carried: Sequence[str], each):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.astype(object).where(frame.notna(), None)
        rows = list(frame[["level", "idx", "bytes"]].itertuples(index=False, name=None))
        above = next(bytes(b) for level, _, b in rows if level == -1)
        below = _below([(level, i, bytes(b)) for level, i, b in rows if level > low], high, above)[low]
        if each is None:
            now = frame[part].iloc[0]
            return pd.DataFrame([(now, i, p) for i, p in (below or {0: above}).items()], columns=[part, "block", "path"])
        leaves = frame[frame["level"] == 0]
        return each(leaves, [below.get(i, above) for i in leaves["idx"]])

    return run


def proven(rows: DataFrame, key: str, part: str, digest: Column, tampered: Column) -> DataFrame:
    """``key``, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``digest``: a row's leaf; ``tampered``: the leaf as it is found now, null where it is as it was. Leaves of a
    partition are in order of ``key`` (nulls first), then of the leaf; partitions in their bytes' order, null
    first. proof_sha256: of all siblings' texts, level by level, left to right. Repeated rows have a leaf each; no
    rows give none. Other columns of ``rows`` don't matter.
    """
    # ids go through Python as text: long ones with nulls among them would become floating-point numbers there
    leaves = rows.select(F.col(key).alias("place"), F.col(key).cast("string").alias("key"), F.col(part).cast("string").alias("part"), digest.alias("digest"), tampered.alias("found"))
    below = tree(leaves, "part", [F.col("place")], ["key", "found"], partitions(rows.sparkSession))
    subroots = checkpointed(below.roots)
    count = subroots.count()
    top = tree(subroots.select(F.lit(0).alias("all"), F.col("part").alias("name"), "digest", "part"), "all", [F.col("name")], ["name"], max(1, min(partitions(rows.sparkSession), count // 10_000)))
    root = top.roots.select("digest").first()
    above = paths(
        top, "all", top.roots.select("all", F.lit(b"").alias("path")), top.leaves.select("all", "idx", "name", "digest"), "part string, path binary, subroot binary",
        lambda leaves, found: pd.DataFrame({"part": leaves["name"].to_numpy(), "path": found, "subroot": leaves["digest"].to_numpy()}),
    )
    above = checkpointed(above)
    whole = bytes(root[0]) if root else b""

    def checked(leaves: pd.DataFrame, found: list[bytes]) -> pd.DataFrame:
        out = []
        for key_, digest_, now, path in zip(leaves["key"], leaves["digest"], leaves["found"], found, strict=True):
            proof = "".join(left + right for left, right in siblings(path))
            folded = fold(bytes(digest_ if now is None else now), path)
            out.append((key_, bytes(digest_).hex(), hashlib.sha256(proof.encode()).hexdigest(), folded.hex(), folded == whole))
        frame = pd.DataFrame(out, columns=["key", "leaf", "proof_sha256", "folded_root", "verified"])
        return frame.assign(part=leaves["part"].to_numpy())

    schema = "key string, leaf string, proof_sha256 string, folded_root string, verified boolean, part string"
    proofs = paths(below, "part", above, below.leaves.select("part", "idx", "key", "digest", "found"), schema, checked)
    sub = above.select(F.col("part").alias("p"), F.lower(F.hex("subroot")).alias("subroot"))
    proofs = proofs.join(sub, F.col("part").eqNullSafe(F.col("p")))
    return proofs.select(F.col("key").cast(rows.schema[key].dataType).alias(key), "leaf", "subroot", F.lit(whole.hex()).alias("root"), "proof_sha256", "folded_root", "verified")


#: The columns of a document that its leaf holds, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_proofs(documents: DataFrame) -> DataFrame:
    """``proven`` of documents by source, where texts of even crc32(doc_id) have lost their line breaks."""
    own = [F.col(c) for c in FIELDS]
    found = leaf_digest([*own[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    return proven(documents, "doc_id", "source", leaf_digest(own), F.when(hit, found))
