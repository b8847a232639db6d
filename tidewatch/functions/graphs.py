"""Connected components of a graph that fits a task."""

from __future__ import annotations

import numpy as np


def least_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n numbered nodes that each is connected with by the edges (a, b): roots hook onto lesser ones, paths are cut short."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
