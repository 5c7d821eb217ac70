"""Least values of sliding windows."""

from __future__ import annotations

import numpy as np


def least_of_windows(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbouring values."""
    n = len(values)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
