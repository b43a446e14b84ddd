"""Places on a Hilbert curve of any number of dimensions (Skilling's transform), for whole arrays."""

from __future__ import annotations

import numpy as np


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Keys of integer points (rows of cells, each below 2**bits); bits * dimensions <= 63."""
    x = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    n = len(x)
    if bits * n > 63:
        raise ValueError("the key needs more than 63 bits")
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess rotations, from the coarsest level down
        below = np.uint64(q - 1)
        for d in range(n):
            inverted = (x[d] & np.uint64(q)) != 0
            swap = np.where(inverted, np.uint64(0), (x[0] ^ x[d]) & below)
            x[0] = np.where(inverted, x[0] ^ below, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
        q >>= 1
    for d in range(1, n):  # Gray code
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros(len(cells), np.uint64)
    q = top
    while q > 1:
        turn = np.where((x[n - 1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):  # bits of all dimensions, the highest first
        for d in range(n):
            key = key << np.uint64(1) | ((x[d] ^ turn) >> np.uint64(b) & np.uint64(1))
    return key
