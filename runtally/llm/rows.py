"""Helpers for operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from runtally.session import cut, ensure_checkpoint_dir

#: Rows that a Python step takes at a time; texts may be long.
STEP = 256
#: Whether the shuffle files of an action go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def steps(batches: Iterator[pa.RecordBatch], size: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``size`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as Python strings; null is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType,
           setup: Callable[[], None] | None = None) -> DataFrame:
    """``fn`` over slices of the batches of ``df``, in Spark tasks."""
    def run(batches):
        if setup is not None:
            setup()
        for part in steps(batches):
            yield fn(part)

    return df.mapInArrow(run, schema)


def remainder(key: Column, of: int) -> Column:
    """crc32 of a key as text modulo ``of``; -1 for a null key, which belongs to no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % of, F.lit(-1))


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there; the shuffle files of writing it go at once.

    Without that they stay until the driver collects its garbage, those of many steps at a time. The frame is planned anew while the
    setting holds, so shuffles of other frames stay.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut(df.select("*"))
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet, compressed, to a new folder in the shared checkpoint folder and read from there."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
