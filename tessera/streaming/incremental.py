"""Incremental scoring and event-time windows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import scoring


def scored(rows: DataFrame) -> DataFrame:
    s = scoring.scores(F.col("prediction"), F.col("answer"))
    return rows.select("*", s["exact"].alias("exact_match"), s["f1"].alias("f1"), s["numeric"].alias("numeric_accuracy"))


def first_good(stream: DataFrame, key: Sequence[str], order: str, prediction: str = "prediction") -> DataFrame:
    """Of each key the last row without an error of the first micro-batch that has one; until then the last error of each batch.

    A key's state says that a good row went out. It lies in the state store, which the checkpoint brings back after
    a failure; a batch reads its own keys' states, however many rows went out before. Many keys want the RocksDB
    store (``spark.sql.streaming.stateStore.providerClass``).
    """

    def choose(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        if state.exists:
            return
        good = rows[rows[prediction] != "[ERROR]"]
        if len(good):
            state.update((True,))
        best = (good if len(good) else rows).sort_values(order, kind="stable")
        yield best.tail(1)

    return stream.groupBy(*key).applyInPandasWithState(choose, stream.schema, "good boolean", "append", GroupStateTimeout.NoTimeout)


def score_incrementally(stream: DataFrame, target: str, checkpoint: str, key: Sequence[str] = ("question_id", "viz_type"), order: str = "ord") -> StreamingQuery:
    """Scores new rows and adds those whose key has no good row yet; error rows are tried anew.

    ``target`` is never read: ``first_good`` knows what went out. Each micro-batch is written to a folder of its
    own, ``batch``, anew: one that stopped half way leaves nothing behind when it runs again. All that is
    available is handled, then the query ends.
    """

    def add(batch: DataFrame, number: int) -> None:
        scored(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    fresh = first_good(stream, list(key), order)
    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums by type and event-time window; works on streams and tables. An extension."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions by user. An extension."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
