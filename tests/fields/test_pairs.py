import numpy as np
import pytest

from tesserae.functions import pairs
from tesserae.operators.trends import pair_trends


def brute(t, v):
    s = [((v[j] - v[i]) * np.sign(t[j] - t[i]), abs(t[j] - t[i])) for i in range(len(t)) for j in range(i + 1, len(t)) if t[i] != t[j]]
    return sum(int(np.sign(a)) for a, _ in s), len(s), sum(a != 0 for a, _ in s), float(np.median([a / b for a, b in s])) if s else float("nan")


@pytest.mark.parametrize("n", [2, 3, 7, 16, 33, 100, 300])
@pytest.mark.parametrize("ties", [False, True])
def test_against_all_pairs(n, ties, monkeypatch):
    rng = np.random.default_rng(n)
    t = rng.integers(0, max(2, n // 3), n).astype(float) if ties else rng.permutation(n) * 1.7
    v = rng.integers(0, 9, n).astype(float) if ties else rng.standard_normal(n).cumsum()
    if len(set(t)) == 1:
        t[0] += 1
    want = brute(t, v)
    assert pairs.kendall(t, v) == want[:3]
    monkeypatch.setattr(pairs, "FEW", 0)  # by counting, for short series too
    assert pairs.median_slope(t, v) == pytest.approx(want[3], rel=1e-9, abs=1e-12)
    for bound in (-0.5, 0.0, 0.31):
        assert pairs.slopes_up_to(t, v, bound) == sum((v[j] - v[i]) / (t[j] - t[i]) <= bound for i in range(n) for j in range(n) if t[i] < t[j])


def test_long_series():
    rng = np.random.default_rng(1)
    t = np.arange(50_000.0)
    v = 0.25 * t + rng.standard_normal(50_000) * 1000
    assert abs(pairs.median_slope(t, v) - 0.25) < 1e-2 and pairs.kendall(t, v)[0] > 0


def test_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(t), float(v)) for g, n in (("a", 40), ("b", 5), ("c", 1)) for t, v in zip(rng.permutation(n), rng.standard_normal(n), strict=True)]
    more = [("a", 99, None), ("a", None, 1.0), ("d", 3, 1.0), ("d", 3, 2.0), ("b", 7, float("nan"))]
    got = {r.g: (r.rises, r.every, r.differ, r.sen) for r in pair_trends(spark.createDataFrame(rows + more, "g string, t int, v double").repartition(3), ["g"]).collect()}
    assert got.keys() == {"a", "b"}
    for g in got:
        t, v = (np.array([r[i] for r in rows if r[0] == g], float) for i in (1, 2))
        assert got[g] == pytest.approx(brute(t, v))
    assert pair_trends(spark.createDataFrame([], "g string, t int, v double"), ["g"]).count() == 0
