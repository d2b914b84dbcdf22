"""Order statistics of sliding windows through a counting tree over score ranks.

Each level of the tree splits the values by one bit of their rank, keeping their order, and knows for every prefix how many
went left. A query (window, rank) walks down one side per level, so all queries of a slice cost O((n + q) log n) in
array operations, whatever the windows' length. Batch and stream share this one function.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# Sent to workers by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def window_order_statistic(values: np.ndarray, start: np.ndarray, stop: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The ``rank``-th smallest (from 1) of ``values[start:stop]`` for every query; NaN where ``rank`` is out of range."""
    out = np.full(len(start), np.nan)
    asked = np.flatnonzero((rank >= 1) & (rank <= stop - start))
    if len(asked) == 0:
        return out
    order = np.argsort(values, kind="stable")
    codes = np.empty(len(values), np.int64)
    codes[order] = np.arange(len(values))
    low, high, left = start[asked].astype(np.int64), stop[asked].astype(np.int64), rank[asked].astype(np.int64)
    found = np.zeros(len(asked), np.int64)
    for bit in range(max(len(values) - 1, 1).bit_length() - 1, -1, -1):
        zero = (codes >> bit) & 1 == 0
        before = np.concatenate([[0], np.cumsum(zero)])  # zeros in every prefix
        count = before[high] - before[low]
        right = left > count
        left = np.where(right, left - count, left)
        found |= right.astype(np.int64) << bit
        low = np.where(right, before[-1] + low - before[low], before[low])
        high = np.where(right, before[-1] + high - before[high], before[high])
        codes = np.concatenate([codes[zero], codes[~zero]])
    out[asked] = values[order[found]]
    return out


def conformal_ranks(sizes: np.ndarray, budget: float) -> np.ndarray:
    """Rank of the split-conformal threshold among ``sizes`` negatives (0 where there are none)."""
    return np.minimum(np.maximum(np.ceil((sizes + 1) * (1 - budget)).astype(np.int64), 1), sizes)


def rolling_thresholds(scores: np.ndarray, seen: np.ndarray, budget: float, history: int, least: int) -> np.ndarray:
    """Threshold of a row before which ``seen`` of the negatives' ``scores`` came, from the last ``history`` of them; NaN
    while there are fewer than ``least``."""
    sizes = np.minimum(seen, history)
    ranks = np.where(sizes >= least, conformal_ranks(sizes, budget), 0)
    return window_order_statistic(scores, seen - sizes, seen, ranks)
