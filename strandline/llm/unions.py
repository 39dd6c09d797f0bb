"""Connected parts of numbered things, from whole arrays of links."""

from __future__ import annotations

import numpy as np


class Unions:
    """The least number of each thing's part, as links come in."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins the parts of each pair: the larger label of a pair goes below the smaller, until none differ."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (up := label[label]).tobytes() != label.tobytes():
                label[:] = up
