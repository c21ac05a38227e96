"""Hilbert keys of projected vectors."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points in [0, 2^bits)^dims; dims * bits <= 63."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    if dims * bits > 63:
        raise ValueError("a key has 63 bits at most")
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level, highest first
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def curve_keys(points: np.ndarray, curves: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """[curve, row] keys: each curve projects on directions of its own and shifts the grid.

    ``points`` have length about one; a projection is spread over (0, 1) by the logistic
    approximation of the normal distribution, takes half of the grid and is shifted by up
    to the other half, so that every curve cuts the space elsewhere.
    """
    width = points.shape[1]
    out = np.empty((curves, len(points)), np.int64)
    for c in range(curves):
        rng = np.random.default_rng([seed, width, c])
        directions, _ = np.linalg.qr(rng.standard_normal((width, min(dims, width))))
        spread = 1 / (1 + np.exp(-1.702 * np.clip(points @ directions * np.sqrt(width), -30, 30)))
        cells = ((spread + rng.random(directions.shape[1])) * (1 << (bits - 1))).astype(np.int64)
        out[c] = hilbert_keys(np.clip(cells, 0, (1 << bits) - 1), bits)
    return out
