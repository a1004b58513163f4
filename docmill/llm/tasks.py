"""What Arrow functions of this folder have in common as Spark tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark hand over texts in batches of at most BATCH_ROWS rows and about BATCH_BYTES, unless the session asks for fewer."""
    if int(spark.conf.get(_ROWS)) > BATCH_ROWS or int(spark.conf.get(_ROWS)) <= 0:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    spark.conf.set(_BYTES, str(BATCH_BYTES))


def free_name(df: DataFrame, base: str) -> str:
    """A name for a column of one's own that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def arrow_task(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, giving unused memory back when a task is over: Python workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return run
