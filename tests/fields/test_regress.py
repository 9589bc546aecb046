import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import kernels
from tesserae.operators import regress


def rows(n=60, k=3, groups=3, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        x = rng.standard_normal((n, k)) * [1, 100, 0.01][:k] + [0, 1e4, 5][:k]
        y = x @ np.array([2.0, -0.03, 40.0])[:k] + rng.standard_normal(n).cumsum() * 0.3 + 1e3
        out += [(g, t, float(y[t]), *map(float, x[t])) for t in range(n)]
    return out


SCHEMA = "g int, t int, y double, x1 double, x2 double, x3 double"


def test_least_squares(spark):
    data = rows()
    missing = [(0, 900, None, 1.0, 1.0, 1.0), (1, 900, 5.0, None, 1.0, 1.0)]
    got = {r.g: r for r in regress.fitted(spark.createDataFrame(data + missing, SCHEMA), ["g"], "y", ["x1", "x2", "x3"]).collect()}
    for g in range(3):
        a = np.array([r[2:] for r in data if r[0] == g])
        x = a[:, 1:] - a[:, 1:].mean(0)
        y = a[:, 0] - a[:, 0].mean()
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        assert got[g].n == 60 and got[g].coefficients == pytest.approx(b, rel=1e-8)
        assert got[g].share == pytest.approx(1 - ((y - x @ b) ** 2).sum() / (y**2).sum(), rel=1e-9)
        assert np.array(got[g].inverse).reshape(3, 3) == pytest.approx(np.linalg.inv(x.T @ x), rel=1e-6)


def test_predictors_that_others_explain(spark):
    data = [(0, t, float(t % 7), float(t), 2.0 * t + 1, float(t * t % 11)) for t in range(40)]
    r = regress.fitted(spark.createDataFrame(data, SCHEMA), ["g"], "y", ["x1", "x2", "x3"]).first()
    x = np.array([(d[3], d[5]) for d in data])
    y = np.array([d[2] for d in data])
    x, y = x - x.mean(0), y - y.mean()
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    assert r.coefficients == pytest.approx([b[0], 0, b[1]]) and r.share == pytest.approx(1 - ((y - x @ b) ** 2).sum() / (y @ y))
    flat = regress.fitted(spark.createDataFrame([(0, t, 5.0, float(t), 1.0, 1.0) for t in range(9)], SCHEMA), ["g"], "y", ["x1", "x2"]).first()
    assert flat.share is None and flat.coefficients == [0.0, 0.0]
    assert regress.fitted(spark.createDataFrame([], SCHEMA), ["g"], "y", ["x1", "x2"]).count() == 0


def test_newey_west(spark):
    data = rows(seed=3)
    got = {r.g: r for r in regress.newey_west(spark.createDataFrame(data, SCHEMA).repartition(4), ["g"], "y", ["x1", "x2", "x3"]).collect()}
    for g in range(3):
        a = np.array([r[2:] for r in data if r[0] == g])
        b, e = kernels.newey_west(a[:, 1:] - a[:, 1:].mean(0), a[:, 0], 4)  # centred, for its digits
        assert (got[g].slope, got[g].error) == pytest.approx((b[1], e[1]), rel=1e-7)
    few = regress.newey_west(spark.createDataFrame([r for r in data if r[1] < 9], SCHEMA), ["g"], "y", ["x1", "x2", "x3"]).collect()
    assert all(r.n == 9 and r.slope is None and r.error is None for r in few)


def test_p_of_t(spark):
    pairs = [(t, n) for t in (0.0, 0.3, -1.7, 2.5, 9.0) for n in (1, 2, 3, 4, 7, 30, 57, 300)]
    df = spark.createDataFrame([(float(t), n) for t, n in pairs] + [(None, 5), (1.0, 0)], "t double, n int")
    got = [r.p for r in df.select(regress.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got[-2:] == [None, None]
    assert got[:-2] == pytest.approx(list(kernels.t_two_sided(np.array([t for t, _ in pairs]), np.array([n for _, n in pairs]))), abs=1e-12)
