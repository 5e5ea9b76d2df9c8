"""Bounds on what Python workers hold."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20
BATCH_ROWS = 2_000


def bounded(spark: SparkSession) -> SparkSession:
    """Let Arrow batches be small, in rows and in bytes, so that long texts do not pile up in a worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = "".join(c for c in spark.conf.get(key) if c.isdigit())
        if not now or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def returned(batches: Iterator) -> Iterator:
    """The same batches; at their end the worker gives free memory back to the system, as it may stay idle for long."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
