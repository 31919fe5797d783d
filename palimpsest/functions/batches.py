"""Bounds on what one Python worker holds at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of one Arrow batch that goes to a Python worker, and rows that are worked out from it at once.
ARROW_BYTES, ROWS = 2 << 20, 128


def bound_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """Bound the bytes of one Arrow batch, unless the session's bound is lower. The plan reads this setting when it runs, so it stays set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")  # a user's own bound in other units stays
    if now.isdigit() and int(now) > size:
        spark.conf.set(name, f"{size}b")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to so many rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
