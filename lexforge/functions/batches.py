"""Parts of Arrow batches of arrays: a batch is 10,000 rows of any length, and what is made of an array takes several times its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Elements of numbers, or bytes of strings, that are looked at together; one row can have more.
MOST = 1 << 19


def parts(rows: pa.ListArray, most: int = MOST) -> Iterator[pa.ListArray]:
    """The rows in order, in slices of ``most`` elements (of strings: bytes) or of one row."""
    edges = rows.offsets.to_numpy().astype(np.int64)
    if pa.types.is_string(rows.type.value_type) or pa.types.is_large_string(rows.type.value_type):
        edges = np.concatenate(([0], np.cumsum(pc.binary_length(rows.values).fill_null(0).to_numpy(), dtype=np.int64)))[edges]
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
        yield rows.slice(at, to - at)
        at = to


def together(columns: list[pa.ListArray], most: int = MOST) -> Iterator[list[pa.ListArray]]:
    """:func:`parts` of several columns of arrays of numbers or structs: the same rows of each."""
    edges = sum(c.offsets.to_numpy().astype(np.int64) - c.offsets[0].as_py() for c in columns)
    at, n = 0, len(columns[0])
    while at < n:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
        yield [c.slice(at, to - at) for c in columns]
        at = to
