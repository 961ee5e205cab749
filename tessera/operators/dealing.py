"""Rows dealt out to tasks of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

#: Rows that a task holds, about, where many rows are dealt out by a key.
TASK_ROWS = 1_000_000


def dealt(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """``rows``, some ``count``, dealt out by ``keys``: to the session's number of partitions, to more where a task would hold over ``TASK_ROWS``."""
    parts = math.ceil(count / TASK_ROWS)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys) if parts > usual else rows.repartition(*keys)
