"""Near-duplicate vectors by sorted projection passes.

Each pass hashes every vector, taken from a centre of its label, with its own random hashes: the
place and sign of the largest of ``DIRECTIONS`` random projections. It orders vectors of a label lexicographically by the
concatenated hashes and compares each with its ``window`` neighbours in that order. Pairs whose
exact cosine passes the threshold are kept and united across all passes. A task
streams its part of the order and holds ``window`` rows of it; the first and last
rows of each part meet those of the next in a second step, so neither cuts nor the
number of partitions change what is compared.

The centres come from a sample of some ``SAMPLE`` vectors a label, by hash: its mean, for the first ``PLAIN`` passes, and
for all others up to ``CELLS`` centres, each row taken from its nearest one, so that hashes tell apart what lies in a
tight cluster. The plain passes find pairs that two cells cut. Labels of no more than ``window`` vectors are compared whole.

Links are counted exactly within the united groups: a group's vectors are compared
in blocks of bounded size, of which each gives one count a vector, so no pairs are
written; a block all of whose vectors lie within half the threshold's angle of their
centre is answered without comparing. The work of a large loose group goes with the
square of its size. Links between two groups that no pass joined are missed.

Exact copies are one class before the passes, so a vector that a third of the
rows share is compared once; its members get the class's links and each other.

Vectors that are null, zero, or hold null or non-finite components, and those
without a label or id, link with nothing; a row without an id is kept. Equal cosines
need no tie rule: a pair links or not. Repeated rows are vectors of their own. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import checkpointed, partitions
from tessera.llm.components import components

#: Vectors in a chunk of a group; a task that counts links compares two chunks.
CHUNK = 2_048
#: Rows of a product of matrices.
TILE = 256
#: Vectors of a label, about, that its centres come from; centres of a label at most; no more centres once each vector is so near to one.
SAMPLE, CELLS, NEAR = 1_024, 32, 0.9
#: Passes that take a label's mean as its only centre.
PLAIN = 3
#: Projections of which a hash names the largest.
DIRECTIONS = 32
#: Up to so many bytes of centres are sent to every executor; beyond, they are joined.
BROADCAST_CENTRES = 8_000_000


def _usable(vector) -> np.ndarray | None:
    if vector is None or len(vector) == 0:
        return None
    out = np.array([np.nan if x is None else x for x in vector], dtype="f8") if isinstance(vector, list) else np.asarray(vector)
    if out.dtype == object:
        out = np.array([np.nan if x is None else x for x in out], dtype="f8")
    return out if np.isfinite(out).all() and out.any() else None


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes, so that copies are equal by a plain key; null if they link with nothing."""
    for frame in frames:
        kept = [_usable(v) for v in frame["embedding"]]
        # one zero: copies that differ in its sign alone are equal vectors
        out = [None if v is None else (v.astype("f8") + 0.0).astype("f4" if v.dtype == np.float32 else "f8").tobytes() for v in kept]
        size = [0 if v is None else v.dtype.itemsize for v in kept]
        yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "vector": out, "width": size})


def _directions(dims: int, passes: int, hashes: int, seed: int) -> np.ndarray:
    """For each pass and hash, directions as columns: at right angles where there are dimensions enough."""
    out = np.random.default_rng(seed).standard_normal((passes, hashes, dims, DIRECTIONS))
    return np.linalg.qr(out)[0] if dims >= DIRECTIONS else out / np.linalg.norm(out, axis=2, keepdims=True)


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=f"<f{width}").reshape(len(vectors), -1).astype("f8")


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that no square overflows or vanishes; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / _norms(x)[:, None]


def _centres(frame: pd.DataFrame) -> pd.DataFrame:
    """The mean of a label's sample, then its cells' centres: vectors farthest from those before, moved to the means of what is nearest."""
    frame = frame.sort_values("vector")  # whatever order the rows come in
    unit = _unit(_matrix(frame["vector"].tolist(), int(frame["kind"].iloc[0]) >> 32))
    best, chosen = unit @ unit[0], [0]
    while len(chosen) < CELLS and best.min() < NEAR:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(3):
        cell = (unit @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, unit)
        filled = np.bincount(cell, minlength=len(centres))[:, None]
        centres = np.where(filled > 0, total / np.maximum(filled, 1), centres)
    centres = np.concatenate([unit.mean(axis=0)[None], centres])
    return pd.DataFrame({"label": frame["label"].iloc[:1].tolist(), "kind": frame["kind"].iloc[:1].tolist(), "centres": [centres.tobytes()]})


def _codes(plain: np.ndarray, celled: np.ndarray, cell: np.ndarray, directions: np.ndarray) -> Iterator[np.ndarray]:
    """Each pass's code of each row: its cell, but in the plain passes, and the hashes, first ones first."""
    for p, some in enumerate(directions):
        x = plain if p < PLAIN else celled
        code = np.zeros(len(x), dtype="i8") if p < PLAIN else cell.astype("i8")
        for hash_ in some:
            y = x @ hash_
            largest = np.abs(y).argmax(axis=1)
            code = code * (2 * DIRECTIONS) + 2 * largest + (y[np.arange(len(y)), largest] < 0)
        yield code


def _run_labels(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """For each of m rows the least row that the links (i, j) join it to."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        # also where a row points to by now
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _near(x: np.ndarray, run: np.ndarray, at: np.ndarray, cosine: float, window: int, since: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join what links: rows of one run, at most ``window`` places apart, one of them not before row ``since``, whose cosine passes."""
    x = _scaled(x)
    unit, norms = _unit(x), _norms(x)
    found = []
    for start in range(since, len(x), TILE):
        low, end = max(0, start - window), min(start + TILE, len(x))
        got = unit[start:end] @ unit[low:end].T
        j, i = np.nonzero(got >= cosine - 1e-9)
        doubtful = np.abs(got[j, i] - cosine) < 1e-9
        i, j = i + low, j + start
        # places, not rows: a frame may lack some between
        near = (i < j) & (at[j] - at[i] <= window) & (run[i] == run[j]).all(axis=1)
        i, j, doubtful = i[near], j[near], doubtful[near]
        # where rounding may decide: cosine of the vectors themselves
        sure = ~doubtful
        a, b = i[doubtful], j[doubtful]
        sure[doubtful] = np.einsum("ij,ij->i", x[a], x[b]) / (norms[a] * norms[b]) >= cosine
        label = _run_labels(i[sure] - low, j[sure] - low, end - low)
        other = np.nonzero(label != np.arange(end - low))[0]
        found.append((label[other] + low, other + low))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, dtype=int),) * 2


PASSED = "a long, b long, part long, size long, place long, pass int, label long, kind long, id long, vector binary"
NAMES = [c.split()[0] for c in PASSED.split(", ")]


def _output(**columns) -> pd.DataFrame:
    size = len(next(iter(columns.values())))
    return pd.DataFrame({c: pd.array(columns[c], dtype="Int64") if c in columns and c != "vector" else columns.get(c, [None] * size) if c == "vector" else pd.array([None] * size, dtype="Int64") for c in NAMES})


def _stream(cosine: float, window: int):
    """Links (a, b) of neighbours in a sorted partition; its size; its first and last rows with their places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, place = TaskContext.get().partitionId(), 0
        held: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame.assign(place=np.arange(place, place + len(frame)))
            place += len(frame)
            first = frame[frame["place"] < window]
            if len(first):
                yield _output(part=[part] * len(first), **{c: first[c].tolist() for c in ("place", "pass", "label", "kind", "id", "vector")})
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            cuts = np.nonzero(np.diff(rows["kind"].to_numpy()))[0] + 1
            for start, end in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                some = rows.iloc[start:end]
                since = max(0, (0 if held is None else len(held)) - start)
                if since >= len(some):
                    continue
                i, j = _near(_matrix(some["vector"].tolist(), int(some["kind"].iloc[0]) >> 32), some[["pass", "label", "kind"]].to_numpy(), some["place"].to_numpy(), cosine, window, since)
                label = _run_labels(i, j, len(some))
                other = np.nonzero(label != np.arange(len(some)))[0]
                if len(other):
                    ids = some["id"].to_numpy()
                    yield _output(a=ids[label[other]], b=ids[other])
            held = rows.iloc[-window:].reset_index(drop=True)
        if held is not None:
            last = held[held["place"] >= window]
            yield _output(part=[part] * len(last), **{c: last[c].tolist() for c in ("place", "pass", "label", "kind", "id", "vector")})
        yield _output(part=[part], size=[place])

    return run


def _across(frame: pd.DataFrame, cosine: float, window: int) -> pd.DataFrame:
    """Links between rows on both sides of a cut."""
    frame = frame.drop_duplicates("at").sort_values("at")
    out = []
    for _, some in frame.groupby("kind"):
        i, j = _near(_matrix(some["vector"].tolist(), int(some["kind"].iloc[0]) >> 32), some[["pass", "label", "kind"]].to_numpy(), some["at"].to_numpy(), cosine, window, 0)
        ids = some["id"].to_numpy()
        out.append(pd.DataFrame({"a": ids[i], "b": ids[j]}))
    return pd.concat(out)


def links(reps: DataFrame, cosine: float, passes: int, hashes: int, window: int, seed: int) -> DataFrame:
    """(a, b) pairs that join what the passes find, of rows (id, label, vector, width)."""
    spark = reps.sparkSession
    reps = reps.withColumn("kind", F.shiftleft(F.col("width").cast("long"), 32) + F.octet_length("vector"))
    counts = reps.groupBy("label", "kind").agg(F.count("*").alias("n"))
    sample = reps.join(counts, ["label", "kind"]).filter(F.pmod(F.xxhash64("vector", F.lit(seed)), F.col("n")) < SAMPLE)
    centres = checkpointed(sample.select("label", "kind", "vector").groupBy("label", "kind").applyInPandas(_centres, "label long, kind long, centres binary"))
    known = None
    if (centres.agg(F.sum(F.octet_length("centres") + 32)).first()[0] or 0) <= BROADCAST_CENTRES:
        known = spark.sparkContext.broadcast({(r["label"], r["kind"]): bytes(r["centres"]) for r in centres.collect()})
        rows = reps.withColumn("centres", F.lit(None).cast("binary"))
    else:
        rows = reps.join(centres, ["label", "kind"])

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directions: dict[int, np.ndarray] = {}
        for frame in frames:
            for kind, part in frame.groupby("kind"):
                x = _unit(_matrix(part["vector"].tolist(), int(kind) >> 32))
                if x.shape[1] not in directions:
                    directions[x.shape[1]] = _directions(x.shape[1], passes, hashes, seed)
                plain, celled, cell = np.empty_like(x), np.empty_like(x), np.empty(len(x), dtype="i8")
                for label, at in part.reset_index(drop=True).groupby("label").indices.items():
                    raw = part["centres"].iloc[at[0]] if known is None else known.value[label, kind]
                    of_label = np.frombuffer(raw).reshape(-1, x.shape[1])
                    cell[at] = (x[at] @ of_label[1:].T).argmax(axis=1)
                    plain[at], celled[at] = x[at] - of_label[0], x[at] - of_label[1:][cell[at]]
                for p, code in enumerate(_codes(plain, celled, cell, directions[x.shape[1]])):
                    yield pd.DataFrame({"pass": p, "label": part["label"], "kind": kind, "code": code, "name": part["name"], "id": part["id"], "vector": part["vector"]})

    n = max(partitions(spark), 1)
    order = ["pass", "label", "kind", "code", "name", "id"]
    rows = rows.withColumn("name", F.xxhash64("vector")).select("label", "kind", "name", "id", "vector", "centres").mapInPandas(hashed, "pass int, label long, kind long, code long, name long, id long, vector binary")
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = checkpointed(rows.select("pass", "label", "kind", "id", "vector").mapInPandas(_stream(cosine, window), PASSED))
    # where each partition starts in the whole order: one number a partition
    sizes = sorted((r["part"], r["size"]) for r in out.filter("size is not null").select("part", "size").collect())
    starts = np.cumsum([0, *(size for _, size in sizes)])
    begins = dict(zip((part for part, _ in sizes), starts.tolist(), strict=False))
    cuts = np.unique(starts[1:-1])

    def beside(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = frame["place"].to_numpy("i8") + np.array([begins[p] for p in frame["part"].tolist()], dtype="i8")
            first, last = np.searchsorted(cuts, at - window, "right"), np.searchsorted(cuts, at + window, "right")
            again = np.repeat(np.arange(len(frame)), last - first)
            cut = np.array([c for a, b in zip(first, last, strict=True) for c in range(a, b)], dtype="i8")
            yield frame.iloc[again].assign(cut=cut, at=at[again])[["cut", "at", "pass", "label", "kind", "id", "vector"]]

    edges = out.filter("place is not null").select("part", "place", "pass", "label", "kind", "id", "vector").mapInPandas(beside, "cut long, at long, pass int, label long, kind long, id long, vector binary")
    across = edges.groupBy("cut").applyInPandas(lambda frame: _across(frame, cosine, window), "a long, b long")
    return out.filter("a is not null").select("a", "b").union(across).distinct()


def _counts(own: np.ndarray, other: np.ndarray, sizes: np.ndarray, cosine: float) -> np.ndarray:
    """For each vector of ``own`` the sum of ``sizes`` of those vectors of ``other`` that it links with."""
    own, other = _scaled(own), _scaled(other)
    unit, to, norms, to_norms = _unit(own), _unit(other), _norms(own), _norms(other)
    out = np.zeros(len(own), dtype="i8")
    for start in range(0, len(own), TILE):
        some = slice(start, start + TILE)
        got = unit[some] @ to.T
        linked = got >= cosine
        # where rounding may decide: cosine of the vectors themselves
        i, j = np.nonzero(np.abs(got - cosine) < 1e-9)
        a = own[some][i]
        linked[i, j] = np.einsum("ij,ij->i", a, other[j]) / (norms[some][i] * to_norms[j]) >= cosine
        out[some] = linked.astype("f8") @ sizes
    return out


def _block(rows: list[tuple], cosine: float) -> list[tuple[int, int]]:
    """(class, links) for each row (class, chunk, kind, size, vector) of a block: a chunk by itself, or two chunks with each other."""
    name, chunk, kind, size, vector = zip(*rows, strict=True)
    x, chunk, size = _matrix(list(vector), int(kind[0]) >> 32), np.array(chunk), np.array(size, dtype="i8")
    unit = _unit(x)
    centre = unit.sum(axis=0)
    length = np.linalg.norm(centre)
    half = np.cos(np.arccos(np.clip(cosine, -1, 1)) / 2)
    first = chunk == chunk.min()
    one = first.all()
    if length > 0 and (unit @ (centre / length)).min() >= half + 1e-9:
        # within half the angle of one centre: each links with every other
        counts = size.sum() - size if one else np.where(first, size[~first].sum(), size[first].sum())
    elif one:
        counts = _counts(x, x, size, cosine) - size  # each links with itself
    else:
        counts = np.zeros(len(x), dtype="i8")
        counts[first] = _counts(x[first], x[~first], size[~first], cosine)
        counts[~first] = _counts(x[~first], x[first], size[first], cosine)
    return list(zip(name, counts.tolist(), strict=True))


def counted(members: DataFrame, cosine: float) -> DataFrame:
    """(class, others): the rows that each class links with in its component; members: class, component, kind, size, vector."""
    chunks = members.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    placed = members.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    placed = placed.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = None, []
        for frame in frames:
            out = []
            for component, low, high, *row in frame.itertuples(index=False, name=None):
                if (component, low, high) != block:
                    out += _done(block, held)
                    block, held = (component, low, high), []
                held.append(row)
            yield pd.DataFrame(out, columns=["class", "others"])
        yield pd.DataFrame(_done(block, held), columns=["class", "others"])

    def _done(block, held: list[tuple]) -> list[tuple[int, int]]:
        # of two chunks that meet, one may be empty: then nothing links
        return _block(held, cosine) if held and (block[1] == block[2] or len({r[1] for r in held}) == 2) else []

    k = partitions(members.sparkSession)
    rows = placed.select("component", "low", "high", "class", "chunk", "kind", "size", "vector").repartition(k, "component", "low", "high").sortWithinPartitions("component", "low", "high", "class")
    return rows.mapInPandas(run, "class long, others long").groupBy("class").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, passes: int = 14, hashes: int = 4, window: int = 512, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id_col, n_links, component_id, kept of every vector."""
    # ids and labels pass Python as text: through floats they would lose their last bits beside nulls
    rows = vectors.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(label_col).cast("long").cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    rows = rows.mapInPandas(_packed, "id string, label string, vector binary, width int")
    rows = checkpointed(rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", "width"))
    rows = rows.withColumn("key", F.when(F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("vector").isNotNull(), F.sha2(F.concat(F.col("width").cast("string").cast("binary"), F.col("vector")), 256)))
    classes = checkpointed(rows.filter("key is not null").groupBy("label", "key").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector"), F.first("width").alias("width")))
    # ids may repeat: a class is named by a number of its own
    classes = checkpointed(classes.withColumn("class", F.monotonically_increasing_id()))
    pairs = checkpointed(links(classes.select(F.col("class").alias("id"), "label", "vector", "width"), cosine, passes, hashes, window, seed))
    parts = checkpointed(components(pairs).withColumnRenamed("node", "class"))
    kind = (F.shiftleft(F.col("width").cast("long"), 32) + F.octet_length("vector")).alias("kind")
    linked = counted(parts.join(classes.select("class", kind, "size", "vector"), "class"), cosine)
    least = parts.join(classes.select("class", "rep"), "class").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = parts.join(least, "component").select("class", "component_id")
    known = classes.select("label", "key", "class", "size", "rep").join(linked, "class", "left").join(named, "class", "left")
    known = known.select("label", "key", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("id", "label", "key").join(known, ["label", "key"], "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
