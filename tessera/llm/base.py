"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``, only where that is unset and none was chosen (tests) a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def _let_go(spark: SparkSession) -> None:
    """Shuffle files of what isn't referenced any more go when both collectors have run, not at some later time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared checkpoint folder."""
    spark = df.sparkSession
    _shared_folder(spark)
    kept = df.checkpoint(eager=True)
    del df
    _let_go(spark)
    return kept


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared checkpoint folder: small, and read by columns."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.tessera_path = path
    del df
    spark.range(1).write.format("noop").mode("overwrite").save()  # the last query's plan is held until another one has run
    _let_go(spark)
    return kept


def forgotten(table: DataFrame) -> None:
    """Deletes the files of a ``written`` table, which nothing that is still to run may read."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.tessera_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch that goes to a Python worker: with long texts, more makes workers and executors grow.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, where they may be greater."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m")
    digits = now.rstrip("b")
    if not digits.isdigit() or not 0 < int(digits) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def lean(run):
    """``run``, a function of an iterator of frames, that gives memory it is done with back to the system: workers stay for later stages."""

    def wrapped(frames: Iterator) -> Iterator:
        yield from run(frames)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the usual C library of Linux
            trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str | Column) -> Column:
    """A text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
