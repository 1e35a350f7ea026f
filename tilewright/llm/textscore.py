"""Hashed byte n-gram models, scored over whole columns at once.

Features are runs of four bytes, hashed to a fixed number of slots, so a model is a table of that size
whatever the corpus. White space counts as one letter and, where case is folded, so does an upper-case
ASCII letter as its lower-case one.
"""

from __future__ import annotations

import numpy as np

SLOTS_BITS = 16
GRAM = 4

_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[9, 10, 11, 12, 13]] = 32
_FOLD = _KEEP.copy()
_FOLD[65:91] += 32


def slots(data: np.ndarray, fold: bool, bits: int = SLOTS_BITS) -> np.ndarray:
    """The slot of the four bytes from each position on; the last three positions have none."""
    b = (_FOLD if fold else _KEEP)[data].astype(np.uint32)
    n = max(0, len(b) - GRAM + 1)
    x = b[:n] | b[1 : n + 1] << np.uint32(8) | b[2 : n + 2] << np.uint32(16) | b[3 : n + 3] << np.uint32(24)
    x *= np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    x *= np.uint32(2246822519)
    return x >> np.uint32(32 - bits)


def gram_rows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one position of each text's own n-grams."""
    first = offsets[:-1]
    return first, np.maximum(first, offsets[1:] - GRAM + 1)


def mean_scores(data: np.ndarray, offsets: np.ndarray, tables: np.ndarray, fold: bool, bits: int = SLOTS_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Per text and table (rows of ``tables``), the mean weight of its n-grams, 0 without any; their number."""
    at = slots(data, fold, bits)
    a, b = (np.minimum(x, len(at)) for x in gram_rows(offsets))
    out = np.zeros((len(offsets) - 1, len(tables)))
    for k, table in enumerate(tables):
        total = np.concatenate([[0.0], np.cumsum(table[at], dtype=np.float64)])
        out[:, k] = (total[b] - total[a]) / np.maximum(b - a, 1)
    return out, b - a
