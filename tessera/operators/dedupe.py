"""Deduplication, upserts and key-set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that is last in ``order``."""
    return _first(rows, key, [F.desc(c) for c in order])


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that is first in ``order``."""
    return _first(rows, key, [F.asc(c) for c in order])


def is_error(prediction: str = "prediction", error: str | None = None) -> Column:
    """An error row: the sentinel, or a filled error column; a null prediction is no error."""
    out = F.coalesce(F.col(prediction) == "[ERROR]", F.lit(False))
    return out | (F.coalesce(F.col(error), F.lit("")) != "") if error else out


def last_good(rows: DataFrame, key: Sequence[str], order: Sequence[str], keep_only_errors: bool = False, error: str | None = None) -> DataFrame:
    """The last row without an error of each key; keys of errors alone are dropped, or keep their last."""
    flagged = rows.withColumn("__bad", is_error(error=error))
    if not keep_only_errors:
        return last_wins(flagged.filter("not __bad").drop("__bad"), key, order)
    return _first(flagged, key, [F.asc("__bad"), *[F.desc(c) for c in order]]).drop("__bad")


def normalized_question(text: Column) -> Column:
    """White space collapsed, lower case, only a-z, 0-9 and blanks."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), "[^a-z0-9 ]", "")


def upsert(rows: DataFrame, updates: DataFrame, key: Sequence[str], columns: Sequence[str], where: Column) -> DataFrame:
    """``rows`` with ``columns`` replaced by those of ``updates`` (one row a key) where ``where`` holds."""
    new = updates.select(*key, *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
    both = rows.join(new, list(key), "left")
    take = F.col("__hit") & where
    return both.select(*[F.when(take, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def pending(wanted: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Wanted rows whose key has no row in ``done``."""
    return wanted.join(done.select(*key), list(key), "left_anti")


def key_difference(rows: DataFrame, manifest: Column, found: Column, key: Sequence[str]) -> DataFrame:
    """Keys of one side only, with ``side`` = missing (of ``manifest`` rows alone) or extra (of ``found`` rows alone), in one pass; null keys are equal."""
    sides = rows.groupBy(*key).agg(F.max(F.coalesce(manifest, F.lit(False))).alias("__a"), F.max(F.coalesce(found, F.lit(False))).alias("__b"))
    return sides.filter("__a <> __b").select(*key, F.when(F.col("__a"), "missing").otherwise("extra").alias("side"))
