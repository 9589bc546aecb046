"""Statistics over all pairs of a series in n log n steps: order changes by merging sorted halves, the median slope by counting slopes below a bound."""

from __future__ import annotations

import math

import numpy as np

#: Up to so many points all slopes are formed.
FEW = 256


def inversions(rank: np.ndarray) -> int:
    """Pairs of which the earlier is greater. All blocks of one size are merged at once: each right half's values are looked up among their own left half's."""
    n = len(rank)
    a = np.full(1 << max(0, n - 1).bit_length(), n, np.int64)  # what is filled up stands last and is greatest
    a[:n] = rank
    total, size = 0, 1
    while size < len(a):
        halves = a.reshape(-1, 2, size)
        apart = np.arange(len(halves)) * (n + 1)
        left, right = (halves[:, i] + apart[:, None] for i in (0, 1))
        among = np.searchsorted(left.ravel(), right.ravel(), side="right") - np.repeat(np.arange(len(halves)) * size, size)
        total += right.size * size - int(among.sum())
        a = np.sort(halves.reshape(len(halves), -1), axis=1).ravel()
        size *= 2
    return total


def _ranks(v: np.ndarray) -> np.ndarray:
    return np.unique(v, return_inverse=True)[1]


def _tied(*columns: np.ndarray) -> int:
    """Pairs that are equal in all the columns."""
    n = np.unique(np.stack(columns), axis=1, return_counts=True)[1]
    return int((n * (n - 1) // 2).sum())


def kendall(t: np.ndarray, v: np.ndarray) -> tuple[int, int, int]:
    """Of the pairs at different times: rises less falls, how many there are, and how many differ in value."""
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    every = len(t) * (len(t) - 1) // 2 - _tied(t)
    differ = every - _tied(v) + _tied(t, v)
    return differ - 2 * inversions(_ranks(v)), every, differ


def slopes_up_to(t: np.ndarray, v: np.ndarray, bound: float) -> int:
    """Pairs at different times with a slope of at most the bound: those that don't rise once the bound's line is taken off."""
    return len(t) * (len(t) - 1) // 2 - _tied(t) - _rises(t, _ranks(v - bound * t))


def _rises(t: np.ndarray, w: np.ndarray) -> int:
    """Pairs of which the later in time is greater: turned around, and falling at one time, they are the order changes."""
    order = np.lexsort((-w, t))
    return inversions(w.max() - w[order])


def median_slope(t: np.ndarray, v: np.ndarray) -> float:
    """The median slope of the pairs at different times, of an even number the mean of the middle two; NaN without a pair."""
    t, v = np.asarray(t, float), np.asarray(v, float)
    every = len(t) * (len(t) - 1) // 2 - _tied(t) if len(t) else 0
    if not every:
        return math.nan
    if len(t) <= FEW:
        i, j = np.triu_indices(len(t), 1)
        apart = t[j] != t[i]
        return float(np.median((v[j][apart] - v[i][apart]) / (t[j][apart] - t[i][apart])))
    times, at = np.unique(t, return_inverse=True)
    low, high = np.full(len(times), np.inf), np.full(len(times), -np.inf)
    np.minimum.at(low, at, v)
    np.maximum.at(high, at, v)
    # The steepest pairs are of neighbouring times.
    ends = float(((low[1:] - high[:-1]) / np.diff(times)).min()), float(((high[1:] - low[:-1]) / np.diff(times)).max())

    def nth(k: int) -> float:
        a, b = ends
        while (m := (a + b) / 2) not in (a, b):
            a, b = (a, m) if slopes_up_to(t, v, m) >= k else (m, b)
        return b

    lower = nth((every + 1) // 2)
    return lower if every % 2 else (lower + nth(every // 2 + 1)) / 2
