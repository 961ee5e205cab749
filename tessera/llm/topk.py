"""Exact top-k inner-product search with two cover trees.

Rows are dealt into blocks: to the nearest of a number of pivots that grows with the
rows, a pivot a block, up to ``MAX_PIVOTS``, then, evenly, to as many blocks a pivot as
its rows need, so no block outgrows a task.
A task builds a block's cover tree; queries get trees of their own the same way.
A pair of trees is searched from both roots: of a query node with centre q and
covering radius r and a row node with centre x and radius s, no inner product
passes q.x + |q|s + |x|r + rs, and the pair is dropped if that is less than the
worst k-th score of the query node's queries so far.

Each query block meets the block of its best bound first; the k-th scores found
there prune whole blocks for it by the blocks' roots before any tree is moved,
and go along as the starting bounds of all later searches.

Components become floor(scale * x), so scores are exact integers: float products
up to 2**53, Python's integers beyond. Ties go to the smaller id, also in pruning:
a pair of nodes is dropped only if its bound is strictly less. Vectors that are
null or empty, or hold null or non-finite components, take no part, nor do rows
without an id; nor, as their scores would not fit a long, vectors with a scaled
component of 2**62 or more. Vectors of different lengths don't meet. Rows that repeat an id are
candidates each; a query's own id is none. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import checkpointed

LEAF, FANOUT = 48, 24
#: The least and the most pivots; they are collected, so their number is bounded.
MIN_PIVOTS, MAX_PIVOTS = 16, 1024
#: Rows whose distances to all pivots are in memory at once.
NEAR = 1024
#: Sums of products up to this are exact in doubles.
EXACT = 2.0**52


@dataclass
class Tree:
    """A cover tree in arrays: node n covers points[start[n]:end[n]] within radius[n] of points[centre[n]]; its children are first[n] .. first[n]+count[n]-1."""

    ids: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def packed(self) -> bytes:
        return pickle.dumps(self, protocol=5)


def build(ids: np.ndarray, points: np.ndarray) -> Tree:
    """Top down: a node's children are a net at half its radius, each point with the nearest; of more than FANOUT the last ones take what is left, within the radius that this needs."""
    order = np.arange(len(points))
    real = points.astype("f8")
    squares = np.einsum("ij,ij->i", real, real)
    start, end, centre, radius, first, count = [], [], [], [], [], []

    def node(a: int, b: int, c: int, r: float) -> int:
        for into, x in ((start, a), (end, b), (centre, c), (radius, r), (first, 0), (count, 0)):
            into.append(x)
        return len(start) - 1

    def far(index: np.ndarray, c: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, squares[index] + squares[c] - 2 * (real[index] @ real[c])))

    root = int(order[np.argmin(squares)])
    todo = [(node(0, len(points), root, float(far(order, root).max())), 0)]
    while todo:
        at, depth = todo.pop()
        a, b, c = start[at], end[at], centre[at]
        if b - a <= LEAF or radius[at] <= 0 or depth > 60:
            continue
        inside = order[a:b]
        nearest = far(inside, c)
        owner = np.zeros(b - a, dtype=int)
        centres = [c]
        while len(centres) < FANOUT and nearest.max() > radius[at] / 2:
            new = int(inside[np.argmax(nearest)])
            d = far(inside, new)
            owner[d < nearest] = len(centres)
            nearest = np.minimum(d, nearest)
            centres.append(new)
        if len(centres) == 1:  # all within half the radius
            radius[at] = float(nearest.max())
            continue
        by = np.argsort(owner, kind="stable")
        order[a:b] = inside[by]
        sizes = np.bincount(owner, minlength=len(centres))
        first[at], count[at] = len(start), len(centres)
        for k, (c2, size) in enumerate(zip(centres, sizes, strict=True)):
            b = a + int(size)
            child = node(a, b, c2, float(nearest[owner == k].max(initial=0.0)))
            todo.append((child, depth + 1))
            a = b
    place = np.empty(len(order), dtype=int)
    place[order] = np.arange(len(order))
    return Tree(ids[order], points[order], np.array(start), np.array(end), place[np.array(centre)], np.array(radius), np.array(first), np.array(count))


def search(queries: Tree, rows: Tree, k: int, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(query id, row id, score): each query's best k of ``rows``, those that may be among its best of all; bounds: k-th scores known before."""
    q, x = queries.points, rows.points
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
    exact = (lambda m: m.astype("f8")) if most < EXACT else (lambda m: m.astype(object))
    fq, fx = q.astype("f8"), x.astype("f8")
    qn, xn = np.linalg.norm(fq[queries.centre], axis=1), np.linalg.norm(fx[rows.centre], axis=1)
    slack = 1 + 1e-9
    best: list[list[tuple[int, int]]] = [[] for _ in q]
    worst = bounds.astype("f8").copy()
    group = np.array([worst[a:b].min() for a, b in zip(queries.start, queries.end, strict=True)])
    parent = np.full(len(queries.start), -1)
    for n in range(len(parent)):
        parent[queries.first[n] : queries.first[n] + queries.count[n]] = n if queries.count[n] else -1
    dots = fq[queries.centre] @ fx[rows.centre].T

    def bound(a: int, b: int) -> float:
        return dots[a, b] + (qn[a] * rows.radius[b] + xn[b] * queries.radius[a] + queries.radius[a] * rows.radius[b]) * slack + 1e-6

    eq, ex = exact(q), exact(x)
    stack = [(bound(0, 0), 0, 0)]
    while stack:
        top, a, b = stack.pop()
        if top < group[a]:
            continue
        leaf_a, leaf_b = not queries.count[a], not rows.count[b]
        if leaf_a and leaf_b:
            sa, ea, sb, eb = queries.start[a], queries.end[a], rows.start[b], rows.end[b]
            scores = eq[sa:ea] @ ex[sb:eb].T
            for i in range(sa, ea):
                s = scores[i - sa]
                for j in np.nonzero(s >= worst[i])[0]:
                    if queries.ids[i] != rows.ids[sb + j]:
                        best[i].append((-int(s[j]), int(rows.ids[sb + j])))
                if len(best[i]) > k:
                    best[i] = sorted(best[i])[:k]
                if len(best[i]) == k:
                    worst[i] = max(worst[i], -max(best[i])[0])
            n = a
            group[n] = worst[sa:ea].min()
            while (n := parent[n]) >= 0:
                group[n] = group[queries.first[n] : queries.first[n] + queries.count[n]].min()
            continue
        # the node with the greater radius opens; the best bound is searched first
        if leaf_b or not leaf_a and queries.radius[a] > rows.radius[b]:
            pairs = [(n, b) for n in range(queries.first[a], queries.first[a] + queries.count[a])]
        else:
            pairs = [(a, n) for n in range(rows.first[b], rows.first[b] + rows.count[b])]
        stack += sorted(t for t in ((bound(*p), *p) for p in pairs) if t[0] >= group[t[1]])
    return [(int(queries.ids[i]), other, -s) for i, found in enumerate(best) for s, other in found]


def _integers(frames: Iterator[pd.DataFrame], scale: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ids, vectors, sizes = [], [], []
        for i, v in zip(frame["id"], frame["vector"], strict=True):
            if v is None or len(v) == 0 or any(c is None for c in v):
                continue
            x = np.floor(np.asarray(v, dtype="f8") * scale)
            if np.isfinite(x).all() and np.abs(x).max() < 2**62:
                ids.append(i)
                vectors.append(x.astype("<i8").tobytes())
                sizes.append(len(x))
        yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "dims": pd.Series(sizes, dtype="int64"), "vector": vectors})


def _points(vectors, dims: int) -> np.ndarray:
    out = np.frombuffer(b"".join(vectors), dtype="<i8").reshape(-1, dims)
    return out.astype("<i4") if np.abs(out).max(initial=0) < 2**31 else out


TREE = "block long, dims long, n long, centre binary, radius double, tree binary"


def _grow(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["id", "vector"])
    dims = int(frame["dims"].iloc[0])
    tree = build(frame["id"].to_numpy("i8"), _points(frame["vector"], dims))
    return pd.DataFrame([(int(frame["block"].iloc[0]), dims, len(frame), tree.points[tree.centre[0]].astype("f8").tobytes(), float(tree.radius[0]), tree.packed())], columns=["block", "dims", "n", "centre", "radius", "tree"])


def _blocks(rows: DataFrame, size: int, pivots: int | None, least: int = MIN_PIVOTS) -> DataFrame:
    """One row a block: its root and its tree. ``pivots`` rows, by hash of their ids, are the sample that the dealing is fitted on; by default one a block, within bounds."""
    pivots = pivots or min(MAX_PIVOTS, max(least, -(-rows.count() // size)))
    sample = [(r["dims"], r["vector"]) for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("dims", "vector").collect()]

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell = np.zeros(len(frame), dtype="i8")
            dims = frame["dims"].to_numpy()
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                own = [v for s, v in sample if s == d]
                if own:
                    p = _points(own, d).astype("f8")
                    for some in np.split(at, range(NEAR, len(at), NEAR)):
                        x = _points(frame["vector"].iloc[some], d).astype("f8")
                        cell[some] = np.argmin((p * p).sum(1)[None, :] - 2 * (x @ p.T), axis=1)
                cell[at] += int(d) * (pivots + 1)
            yield frame.assign(cell=cell)

    dealt = checkpointed(rows.mapInPandas(near, "id long, dims long, vector binary, cell long"))
    counts = dealt.groupBy("cell").count().select("cell", F.ceil(F.col("count") / size).alias("parts"))
    # a row a pivot: bounded by the sample
    placed = dealt.join(F.broadcast(counts), "cell").withColumn("block", F.xxhash64("cell", F.pmod(F.xxhash64("id"), "parts")))
    return checkpointed(placed.select("block", "id", "dims", "vector").groupBy("block").applyInPandas(_grow, TREE))


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, queries, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, query_block: int = 1024, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries``: a condition on a column ``id`` that chooses the query rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("id is not null").mapInPandas(lambda frames: _integers(frames, scale), "id long, dims long, vector binary")
    rows = checkpointed(rows)
    # a query id that repeats asks once, with the vector that is least as bytes
    asked = rows.filter(queries).groupBy("id").agg(F.min(F.struct("dims", "vector")).alias("v")).select("id", "v.dims", "v.vector")
    data, wanted = _blocks(rows, block, pivots), _blocks(checkpointed(asked), query_block, None, 4)
    roots = data.select(F.col("block").alias("d_block"), "dims", F.col("centre").alias("d_centre"), F.col("radius").alias("d_radius"))
    # roots only, a few hundred bytes a block of thousands of rows, meet here
    bound = F.pandas_udf(_root_bounds, "double")("centre", "radius", "d_centre", "d_radius")
    pairs = checkpointed(wanted.select("block", "dims", "centre", "radius").join(roots, "dims").select("block", "d_block", bound.alias("bound")))
    first = pairs.groupBy("block").agg(F.max_by("d_block", F.struct("bound", "d_block")).alias("d_block"))
    trees = data.select(F.col("block").alias("d_block"), F.col("tree").alias("d_tree"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, other, known in zip(frame["tree"], frame["d_tree"], frame["known"], strict=True):
                tree = pickle.loads(own)
                at = {r["id"]: r["score"] for r in known} if known is not None else {}
                bounds = np.array([at.get(int(i), -np.inf) for i in tree.ids], dtype="f8")
                # a bound that doubles can't hold is lowered
                bounds = np.where(np.abs(bounds) < EXACT, bounds, np.nextafter(bounds, -np.inf))
                yield pd.DataFrame(search(tree, pickle.loads(other), k, bounds), columns=["query_id", "vec_id", "score"])

    def best(found: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    own = wanted.select("block", "tree")
    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    started = checkpointed(first.join(own, "block").join(trees, "d_block").withColumn("known", none).select("block", "tree", "d_tree", "known").mapInPandas(run, FOUND))
    kth = best(started).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    member = checkpointed(wanted.select("block", "tree").mapInPandas(_members, "block long, id long"))
    known = member.join(kth, "id").groupBy("block").agg(F.collect_list(F.struct("id", "score")).alias("known"), F.count("*").alias("n_known"), F.min("score").alias("least"))
    sizes = wanted.select("block", "n")
    known = sizes.join(known, "block", "left")
    rest = pairs.join(first.withColumnRenamed("d_block", "done"), "block").filter("d_block <> done").join(known, "block").filter("coalesce(n_known, 0) < n or bound >= least")
    later = rest.join(own, "block").join(trees, "d_block").select("block", "tree", "d_tree", "known").mapInPandas(run, FOUND)
    return best(started.union(later)).select("query_id", "rank", "vec_id", "score")


def _members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for block, tree in zip(frame["block"], frame["tree"], strict=True):
            yield pd.DataFrame({"block": block, "id": pickle.loads(tree).ids})


def _root_bounds(centre: pd.Series, radius: pd.Series, d_centre: pd.Series, d_radius: pd.Series) -> pd.Series:
    out = []
    for c, r, d, s in zip(centre, radius, d_centre, d_radius, strict=True):
        q, x = np.frombuffer(c), np.frombuffer(d)
        out.append(float(q @ x + (np.linalg.norm(q) * s + np.linalg.norm(x) * r + r * s) * (1 + 1e-9) + 1e-6))
    return pd.Series(out, dtype="f8")
