"""Helpers the operators of this folder share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftscope.session import scratch_path

#: ASCII white space; everything else belongs to a word. ``bytes.split()`` cuts at exactly these bytes.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def place(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of the scope, or in the shared folder."""
    folder = _FOLDER.get()
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}" if folder else scratch_path(spark, name)


def saved(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (that of the scope, if there is one) and read it back: short plans, and a lost executor costs no recomputation."""
    path = path or place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is saved inside is deleted at the end, with the shuffles that led to it. A result that outlives it is saved to a ``path`` outside."""
    folder = place(spark, "scope")
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        release(spark)


def begin(spark: SparkSession) -> None:
    """Before a stage of a pipeline: texts go to Python in small batches, and what the stage before has left is let go."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    release(spark)


def small_batches(spark: SparkSession) -> None:
    """Whole texts leave Parquet and go to Python some hundred at a time: by default thousands of them wait on both sides, tens of MB a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def release(spark: SparkSession) -> None:
    """Let go of the shuffles of finished jobs: Spark deletes them once nothing in the driver refers to them any more."""
    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if a column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that Python holds few texts at once. At the end Arrow gives back what it keeps for more, as workers stay."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()


def groups_of(df: DataFrame, text: str, group_bytes: int) -> int:
    """Number of groups of about ``group_bytes`` bytes of text each."""
    total = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0]
    return max(1, -(-int(total or 0) // group_bytes))
