"""Distances to nearest points and counts of points in balls, in the largest norm, without the distances of all pairs."""

from __future__ import annotations

from itertools import product

import numpy as np

#: Candidate pairs held at a time.
PAIRS = 4_000_000


def kth_distance(points: np.ndarray, k: int) -> np.ndarray:
    """The distance of each point (rows) to its k-th nearest other point.

    Points are sorted into cells of one width. All points within a width of a point lie in its own and the adjacent cells, so a k-th distance of at most
    the width is final; the others try cells of twice the width.
    """
    n, d = points.shape
    if n <= k:
        return np.full(n, np.inf)
    out, open_ = np.full(n, np.inf), np.arange(n)
    low = points.min(0)
    span = float((points.max(0) - low).max())
    # From cells so small that few share one: those of the median step between sorted values of an axis, or where values repeat of the smallest.
    steps = np.concatenate([np.diff(np.sort(points[:, i])) for i in range(d)])
    steps = steps[steps > 0]
    if not len(steps):
        return np.zeros(n)
    width = max(float(np.quantile(steps, 0.01)), span * 2.0**-60)
    while len(open_):
        if width >= span:
            width = 2 * span  # one cell holds all
        cells = np.floor((points - low) / width).astype(np.int64)
        keys, at = np.unique(cells, axis=0, return_inverse=True)
        order = np.argsort(at, kind="stable")
        begin = np.searchsorted(at[order], np.arange(len(keys) + 1))
        index = _Rows(keys)
        done = np.zeros(len(open_), bool)
        part = max(1, PAIRS // max(1, 3**d * k))
        first = 0
        while first < len(open_):
            mine = open_[first : first + part]
            found = np.stack([index.find(cells[mine] + np.array(step)) for step in product((-1, 0, 1), repeat=d)], 1)
            sizes = np.where(found >= 0, begin[found + 1] - begin[found], 0)
            many = sizes.sum(1).cumsum()
            keep = max(1, int(np.searchsorted(many, PAIRS, "right")))
            mine, found, sizes = mine[:keep], found[:keep], sizes[:keep]
            total = sizes.sum(1)
            enough = total > k  # with the point itself
            if enough.any():
                rows = np.flatnonzero(enough)
                f, s = found[rows].ravel(), sizes[rows].ravel()
                starts = np.repeat(begin[np.maximum(f, 0)], s)
                others = order[starts + np.arange(s.sum()) - np.repeat(s.cumsum() - s, s)]
                own = np.repeat(np.arange(len(rows)), total[rows])
                away = np.abs(points[others] - points[mine[rows]][own]).max(1)
                away[others == mine[rows][own]] = np.inf
                ranked = np.lexsort((away, own))
                kth = away[ranked][(total[rows].cumsum() - total[rows]) + k - 1]
                final = (kth <= width) | (width >= span)
                out[mine[rows[final]]] = kth[final]
                done[first + rows[final]] = True
            first += keep
        open_ = open_[~done]
        width *= 2
    return out


class _Rows:
    """Finds rows of whole numbers among sorted different ones."""

    def __init__(self, keys: np.ndarray):
        self.low, self.high = keys.min(0), keys.max(0)
        self.columns = [np.unique(keys[:, i]) for i in range(keys.shape[1])]
        self.packed = self._pack(keys)
        self.order = np.argsort(self.packed)
        self.sorted = self.packed[self.order]

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        """A number a row from its places among each column's values: unique where all are there."""
        out, good = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        for i, column in enumerate(self.columns):
            at = np.minimum(np.searchsorted(column, rows[:, i]), len(column) - 1)
            good &= column[at] == rows[:, i]
            out = out * len(column) + at
        return np.where(good, out, -1)

    def find(self, rows: np.ndarray) -> np.ndarray:
        packed = self._pack(rows)
        at = np.minimum(np.searchsorted(self.sorted, packed), len(self.sorted) - 1)
        return np.where((packed >= 0) & (self.sorted[at] == packed), self.order[at], -1)


def strict_range(ordered: np.ndarray, x: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each x the places [lo, hi) of sorted values whose distance from it is below e; ends are checked by the distance itself, as x - e is rounded."""
    n = len(ordered)
    lo, hi = np.searchsorted(ordered, x - e, "right"), np.searchsorted(ordered, x + e, "left")
    inside = lambda at: np.abs(ordered[np.clip(at, 0, n - 1)] - x) < e
    while (more := (lo > 0) & inside(lo - 1)).any():
        lo = lo - more
    while (less := (lo < hi) & ~inside(lo)).any():
        lo = lo + less
    while (more := (hi < n) & inside(hi)).any():
        hi = hi + more
    while (less := (hi > lo) & ~inside(hi - 1)).any():
        hi = hi - less
    return lo, hi


class RangeCounts:
    """Counts of values below a bound within ranges of places: a bit of the ranks a level, the greatest first, places with a 0 before those with a 1."""

    def __init__(self, ranks: np.ndarray):
        self.n, self.levels = len(ranks), []
        for bit in range(max(1, self.n.bit_length()) - 1, -1, -1):
            ones = (ranks >> bit) & 1
            zeros = np.r_[0, (1 - ones).cumsum()]
            self.levels.append((bit, zeros))
            ranks = np.concatenate([ranks[ones == 0], ranks[ones == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of the places [lo, hi) are below each bound (from 0 to the number of values)."""
        out = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            one = (bound >> bit) & 1 == 1
            zl, zh = zeros[lo], zeros[hi]
            out += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, zeros[-1] + lo - zl, zl), np.where(one, zeros[-1] + hi - zh, zh)
        return out


def ball_counts(x: np.ndarray, y: np.ndarray | None, e: np.ndarray) -> np.ndarray:
    """How many other points lie nearer than e to each point, in x alone or in the larger of both distances."""
    order = np.argsort(x, kind="stable")
    lo, hi = strict_range(x[order], x, e)
    if y is None:
        return np.maximum(hi - lo - 1, 0)
    by_y = np.argsort(y, kind="stable")
    rank = np.empty(len(y), np.int64)
    rank[by_y] = np.arange(len(y))
    counts = RangeCounts(rank[order])
    low, high = strict_range(y[by_y], y, e)
    return np.maximum(counts.below(lo, hi, high) - counts.below(lo, hi, low) - 1, 0)
