"""Frames kept between the steps of a loop."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def kept(rows: DataFrame) -> DataFrame:
    """Cut off from what made it, in the shared checkpoint folder; without one only a local session takes a temporary folder."""
    spark = rows.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return rows.checkpoint()
