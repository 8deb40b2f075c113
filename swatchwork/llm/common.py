"""What the operators of this subpackage share: reading tables, folds, checkpoints, checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the row contracts have them: runs without space and the control characters 0x09 to 0x0D.
SPACES = r"[ \t-\r]+"
#: Rows of a few numbers up to which a table is sent to all executors; larger ones are joined by a shuffle.
SMALL_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is named, a local session gets one of its own; a cluster has to name one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the checkpoint folder and read again. The folder goes with the session's checkpoints."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Whole rows go to Python workers and back in batches of so many rows and bytes at most, for the rest of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Hands the memory that this Python process no longer uses back to the system, as workers and the driver live on between stages; where the C library can."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def learned_on_driver(model):
    """The model, after what it was learned from has left the driver's memory: that stays as large as it was otherwise, through all stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back()
    return model


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for a broadcast if it has at most ``rows`` rows; Spark joins it by a shuffle otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
