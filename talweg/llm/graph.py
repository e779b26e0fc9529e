"""Links within one bounded group, in numpy."""

from __future__ import annotations

import numpy as np


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least row that each row reaches by links (left[i], right[i])."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
