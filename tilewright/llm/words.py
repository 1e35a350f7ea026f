"""Columns of whole texts as flat numpy arrays: bytes, words, documents.

Words are runs of characters other than the six ASCII white-space characters, U+0020 and
U+0009 to U+000D. Arrow splits them in C++; nothing here loops over words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in slices of about so many bytes, which bounds a task's memory whatever the batch.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch holding about ``limit`` bytes of ``column``; a longer text stands alone."""
    n = batch.num_rows
    if n == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end, and n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words end to end, and each word's row; null has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    values = parts.flatten()
    rows = np.asarray(pc.list_parent_indices(parts), dtype=np.int64)
    full = pc.greater(pc.binary_length(values), 0)
    return values.filter(full), rows[np.asarray(full.to_numpy(zero_copy_only=False), dtype=bool)]


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts, or sums of integer weights, by row."""
    if weights is None:
        return np.bincount(rows, minlength=n).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
    ends = np.searchsorted(rows, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]


def give_back() -> None:
    """Return the freed memory of a reused Python worker to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
