import math
import time

import numpy as np
import pytest

from tesserae.functions import kernels, nearest


def brute(source, target, k=4, seed=0):
    """The estimator by all distances."""
    rng = np.random.default_rng(seed)
    s, y = ((v - v.mean()) / v.std() + 1e-10 * rng.standard_normal(len(v)) for v in (source, target))
    a, b, c = y[1:], y[:-1], s[:-1]
    da, db, dc = (np.abs(v[:, None] - v[None]) for v in (a, b, c))
    joint = np.maximum(np.maximum(da, db), dc)
    np.fill_diagonal(joint, np.inf)
    e = np.partition(joint, k - 1, 1)[:, k - 1 : k]
    count = lambda d: (d < e).sum(1) - 1
    terms = [kernels.digamma(np.array([float(k)]))[0] + kernels.digamma(count(db) + 1.0) - kernels.digamma(count(np.maximum(da, db)) + 1.0) - kernels.digamma(count(np.maximum(db, dc)) + 1.0)]
    return float(np.mean(terms)), e[:, 0]


@pytest.mark.parametrize("n", [8, 30, 200, 700])
@pytest.mark.parametrize("kind", ["normal", "repeated", "heavy", "clusters"])
def test_against_all_distances(n, kind):
    rng = np.random.default_rng(n)
    s, y = rng.standard_normal((2, n)).cumsum(1) if kind == "normal" else rng.integers(0, 4, (2, n)).astype(float) if kind == "repeated" else rng.standard_cauchy((2, n)) if kind == "heavy" else rng.integers(0, 2, (2, n)) * 1e3 + rng.standard_normal((2, n)) * 1e-3
    s[0] += 1.5
    want, e = brute(s, y)
    assert kernels.transfer_entropy(s, y) == pytest.approx(want, abs=1e-12)


def test_distances_and_counts():
    rng = np.random.default_rng(3)
    for d, n, k in ((1, 50, 1), (2, 300, 5), (3, 300, 4)):
        x = np.round(rng.standard_normal((n, d)), 1)
        away = np.abs(x[:, None] - x[None]).max(2)
        np.fill_diagonal(away, np.inf)
        e = np.sort(away, 1)[:, k - 1]
        assert np.array_equal(nearest.kth_distance(x, k), e)
        y = rng.integers(0, 9, n).astype(float)
        both = np.maximum(np.abs(x[:, None, 0] - x[None, :, 0]), np.abs(y[:, None] - y[None]))
        e = rng.choice([0.3, 1.0, 2.5], n)
        assert np.array_equal(nearest.ball_counts(x[:, 0], y, e), (both < e[:, None]).sum(1) - 1)
        assert np.array_equal(nearest.ball_counts(x[:, 0], None, e), (np.abs(x[:, None, 0] - x[None, :, 0]) < e[:, None]).sum(1) - 1)
    assert np.isinf(nearest.kth_distance(np.zeros((3, 2)), 3)).all() and (nearest.kth_distance(np.zeros((5, 2)), 3) == 0).all()


def test_long_series():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(100_000)
    y = np.r_[0.0, 0.8 * x[:-1]] + 0.3 * rng.standard_normal(100_000)
    began = time.process_time()
    assert kernels.transfer_entropy(x, y) > 0.5 and time.process_time() - began < 120
    assert math.isnan(kernels.transfer_entropy(np.ones(50), x[:50]))
