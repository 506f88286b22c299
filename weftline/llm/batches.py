"""Arrow batches cut by text volume, and Python workers that hold no more than the kernel they run needs."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CHUNK_BYTES = 4 << 20

#: What kernels keep in a worker between tasks: name of the kernel -> what empties it.
_held: dict[str, Callable[[], None]] = {}


def held_by(owner: str, clear: Callable[[], None]) -> None:
    """Say how to empty what the kernels of ``owner`` keep in a worker; another owner's task does so."""
    _held[owner] = clear


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Return memory that nothing uses to the system; Arrow and the C library would hold it for this worker."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def take_over(owner: str) -> None:
    """Drop what the kernels of others left in this worker."""
    for name, clear in _held.items():
        if name != owner:
            clear()
    give_back()


def settled(owner: str) -> Callable:
    """For kernels over batches: empty what other kernels keep in this worker before, and give memory back after.

    Spark reuses workers for tasks of all kinds, so else the tables of every kernel that ever ran would add up.
    """

    def wrap(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        @wraps(kernel)
        def run(batches):
            take_over(owner)
            try:
                yield from kernel(batches)
            finally:
                give_back()

        return run

    return wrap


BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", ("64m", "67108864b", "67108864"), "8m"


def small_batches(df: DataFrame) -> DataFrame:
    """Have Spark cut batches for Python at 8 MB, unless the session says otherwise; texts are long, and either side
    holds a few batches at once."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, None) in BATCH_DEFAULT:
        conf.set(BATCH_KEY, BATCH_BYTES)
    return df


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``most`` bytes of ``column`` each; a longer text is a slice alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
