"""Disjoint sets over the entries of one task, in numpy."""

from __future__ import annotations

import numpy as np


def union(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Merge the sets of x[i] and y[i]; ``label`` maps each entry to its set's smallest entry."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
