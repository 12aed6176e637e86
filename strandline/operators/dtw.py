"""Dynamic time warping of batches of pairs, along anti-diagonals, in numpy."""

from __future__ import annotations

import numpy as np


def stretch01(x: np.ndarray) -> np.ndarray:
    """(N, T, D): every dimension of every sequence to 0..1 over time; one step stays as it is."""
    if x.shape[1] < 2:
        return x
    low = x.min(axis=1, keepdims=True)
    return (x - low) / np.maximum(x.max(axis=1, keepdims=True) - low, 1e-8)


def frame_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(N, Ta, Tb) Euclidean distances, by differences (the expanded form loses digits for like frames)."""
    out = np.zeros((a.shape[0], a.shape[1], b.shape[1]))
    for k in range(a.shape[2]):
        step = a[:, :, None, k] - b[:, None, :, k]
        out += step * step
    return np.sqrt(out, out=out)


def warp(cost: np.ndarray) -> np.ndarray:
    """Least total cost of a monotone path through each (Ta, Tb) matrix of the batch.

    Cell (i, j) of anti-diagonal s = i + j needs only the two diagonals before it, so three rolling rows of width
    Ta + 1 are all the state there is.
    """
    n, ta, tb = cost.shape
    older = np.full((n, ta + 1), np.inf)
    newer = np.full((n, ta + 1), np.inf)
    older[:, 0] = 0.0
    for s in range(ta + tb - 1):
        first, last = max(0, s - tb + 1), min(ta - 1, s)
        rows = np.arange(first, last + 1)
        now = np.full((n, ta + 1), np.inf)
        came = np.minimum(np.minimum(newer[:, rows], newer[:, rows + 1]), older[:, rows])
        now[:, rows + 1] = cost[:, rows, s - rows] + came
        older, newer = newer, now
    return newer[:, ta]


def dtw_distance(a: np.ndarray, b: np.ndarray, normalize: bool) -> np.ndarray:
    """Path cost over the sum of both lengths, for a batch of pairs of like shape (N, Ta, D), (N, Tb, D)."""
    if normalize:
        a, b = stretch01(a), stretch01(b)
    return warp(frame_distances(a, b)) / (a.shape[1] + b.shape[1])
