"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of texts that are handed to Python at a time.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20


def released(task: Callable) -> Callable:
    """A task's generator whose memory goes back to the system when the task ends, not when the worker does."""

    @wraps(task)
    def run(batches) -> Iterator:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Actions inside hand texts to Python in small batches; the session's own settings come back afterwards."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows), spark.conf.get(size)
    spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(rows, before[0])
        spark.conf.set(size, before[1])
