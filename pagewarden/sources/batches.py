"""Small parts of Arrow batches: what a Python worker holds does not grow with its task.

Spark hands a worker up to 10,000 rows at once, whatever their size. Pages become objects of some thirty
times their bytes, so workers take a batch in parts, and batches themselves are kept small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

#: Bytes of text and rows that a worker turns into objects at once; one row may be larger.
PART_BYTES, PART_ROWS = 1 << 20, 250
#: Bytes and rows of a batch.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1000


#: Bytes of the units that sizes are set in.
_UNITS = {u: 1 << 10 * i for i, u in enumerate("bkmgtp")}


def _size(said: str) -> int:
    """A number, with a unit or without, as settings have it: 10000, 67108864b, 64m, 1g."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([bkmgtp]?)b?", said.strip().lower()).groups()
    return int(number) * _UNITS[unit or "b"]


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch sizes where they are higher."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = _size(spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def parts(sizes: np.ndarray, most: int = PART_BYTES, rows: int = PART_ROWS) -> Iterator[tuple[int, int]]:
    """(first, end) of parts of rows of these sizes, in order: within both limits, or one row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(ends):
        fit = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right"))
        end = min(max(fit, first + 1), first + rows)
        yield first, end
        first = end
