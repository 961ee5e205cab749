"""Best-fit decreasing packing of tokenised documents into windows.

A document longer than a window is first cut into full windows; what is left of
it, and every shorter document, is a piece that goes, longest first, to the open
window with the least room that still holds it. A segment tree over the remaining
capacities finds that window in log2(capacity) steps.

Pieces are dealt over groups at random but evenly, by a number given to each row,
and each group packs its own. A group has a bounded number of pieces (``group``),
so it fits a task at any input size, and padding is at most about a window a
group. Tokenising moves no text: what is shuffled is one short row a piece.

Null texts count as empty; an empty document is its end id alone; ties go by
(doc_id as text, start), then row; repeated rows are packed as often as they occur; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.base import checkpointed, lean, small_batches, whole


class Fit:
    """Open windows by remaining capacity: a segment tree over 0..capacity counts them."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        k = room + self.leaves
        while k:
            self.counts[k] += 1
            k >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with room for ``size``, taken out; None if there's none."""
        counts, k = self.counts, size + self.leaves
        while not counts[k]:
            while k & 1:  # a right child: what follows is right of an ancestor
                k >>= 1
            if not k:
                return None
            k += 1
        while k < self.leaves:
            k <<= 1
            if not counts[k]:
                k += 1
        room = k - self.leaves
        while k:
            counts[k] -= 1
            k >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) of each length, which come longest first."""
    out, fit, windows = [], Fit(capacity), 0
    for size in lengths:
        found = fit.take(size)
        if found is None:
            room, window = capacity, windows
            windows += 1
        else:
            room, window = found
        out.append((window, capacity - room))
        if room > size:
            fit.add(room - size, window)
    return out


PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(documents: DataFrame, ranks_path: str, pattern: str, window: int, end_id: int) -> DataFrame:
    """One row a piece: full windows of a document, then what is left."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = memoryview(tokens.ids(text, ranks_path, pattern) + end)
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    small_batches(documents.sparkSession)
    # ids come and go as text: through floats they would lose their last bits beside nulls
    return documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), whole("text").alias("text")).mapInPandas(lean(run), PIECE)


def packed(documents: DataFrame, ranks_path: str, pattern: str, window: int = 1024, end_id: int = 0, group: int = 20_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    rows = checkpointed(pieces(documents, ranks_path, pattern, window, end_id).withColumn("row", F.monotonically_increasing_id()))
    short = rows.filter(F.col("length") < window)
    full = rows.filter(F.col("length") == window)
    groups = max(1, -(-short.count() // group))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True], kind="stable")
        at = best_fit(frame["length"].tolist(), window)
        base = int(frame["bin"].iloc[0]) << 32
        return frame.assign(sequence_id=[base + w for w, _ in at], offset=[o for _, o in at]).drop(columns=["row", "bin"])

    dealt = short.withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("bin").applyInPandas(pack, f"{PIECE}, sequence_id long, offset long")
    # a full window is a sequence by itself; its number is negative, and so unlike any packed one's
    alone = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.unionByName(alone).withColumn("doc_id", F.col("doc_id").cast("long"))
