"""Positions along a Hilbert curve of any number of dimensions."""

from __future__ import annotations

import numpy as np


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each row of ``coordinates`` (rows x dimensions, 0 to 2**bits - 1).

    The transpose form: bits of all dimensions are walked from the top, reflecting and
    swapping lower bits as the curve turns, then Gray-decoded and interleaved. All rows at
    once. Needs dimensions * bits of 63 at most.
    """
    x = np.array(coordinates, dtype=np.int64).T.copy()
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("index does not fit into 63 bits")
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for d in range(dims):
            turned = (x[d] & level) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip ^= np.where(x[dims - 1] & level, level - 1, 0)
        level >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> bit) & 1)
    return index
