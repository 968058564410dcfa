"""Points of the E8 lattice: decoding, and the neighbours nearest to a point."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np

DIMS = 8


def nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum (the lattice D8)."""
    point = np.rint(y)
    odd = np.flatnonzero(point.sum(1) % 2 != 0)
    error = y[odd] - point[odd]
    worst = np.abs(error).argmax(1)
    rows = np.arange(len(odd))
    point[odd, worst] += np.where(error[rows, worst] >= 0, 1, -1)
    return point


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points: of D8 and D8 moved by one half, whichever is closer."""
    whole, half = nearest_even(y), nearest_even(y - 0.5) + 0.5
    closer = ((y - half) ** 2).sum(1) < ((y - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


def shortest_vectors() -> np.ndarray:
    """The 240 lattice points next to the origin."""
    rows = []
    for i, j in combinations(range(DIMS), 2):
        for a, b in product((1, -1), repeat=2):
            row = [0.0] * DIMS
            row[i], row[j] = a, b
            rows.append(row)
    rows += [signs for signs in product((0.5, -0.5), repeat=DIMS) if sum(x < 0 for x in signs) % 2 == 0]
    return np.array(rows)


SHORTEST = shortest_vectors()


def cells(y: np.ndarray, neighbours: int) -> np.ndarray:
    """Doubled (so whole) coordinates of the home point and its ``neighbours`` neighbours nearest to ``y``: (rows, 1 + neighbours, 8)."""
    home = decode(y)
    inside = (y - home) @ SHORTEST.T
    near = np.argpartition(-inside, neighbours, axis=1)[:, :neighbours] if neighbours else np.zeros((len(y), 0), int)
    order = np.take_along_axis(-inside, near, 1).argsort(1)
    near = np.take_along_axis(near, order, 1)
    points = np.concatenate([home[:, None], home[:, None] + SHORTEST[near]], 1)
    return np.rint(points * 2).astype(np.int64)
