"""Arrow batches in Python workers, which are used again by later tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows that are looked at together, at most.
ROWS = 512


def tidy() -> None:
    """Gives memory that is free back to the system, as far as it can be: a worker is kept, and what it has had at its peak would stay with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def small(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows each, as what is made of a text takes several times its bytes; afterwards the worker is tidied."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            del batch
    finally:
        tidy()
