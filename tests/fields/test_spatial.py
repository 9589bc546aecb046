"""Phases against NumPy, and the spatial tests' calibration on random fields: many trials in one job each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import kernels
from tesserae.operators import grid, series, spectral, stats


def test_phase_chain_is_numpys(spark):
    r = np.random.default_rng(2)
    months = np.arange(96)
    data = {c: np.sin(2 * np.pi * months / (14 + 3 * c)) + 0.02 * months + (months % 12) * 0.3 + 0.2 * r.normal(size=96) for c in range(4)}
    rows = [(c, int(t), int(t % 12), float(v)) for c, x in data.items() for t, v in enumerate(x)]
    field = spark.createDataFrame([x for x in rows if x[:2] != (3, 40)], "cell long, t long, month int, v double")
    d = series.detrend(series.anomaly(field, ["cell"]), ["cell"], "a").select("cell", "t", F.col("d").alias("v"))
    whole = series.complete_only(d, ["cell"], 96)
    got = spectral.phase_of(whole, ["cell"], 40.0, 8.0).where("t BETWEEN 6 AND 89").collect()
    assert {x.cell for x in got} == {0, 1, 2}  # the one with a gap has no phase
    sections = kernels.butterworth(4, 2 / 40, 2 / 8)
    z = {}
    for c in range(3):
        a = data[c] - np.array([data[c][m::12].mean() for m in range(12)])[months % 12]
        a = a - np.polyval(np.polyfit(months, a, 1), months)
        z[c] = kernels.analytic(kernels.zero_phase(sections, a[None]))[0]
    for x in got:
        assert x.phase == pytest.approx(np.angle(z[x.cell][x.t]), abs=1e-8) and x.amplitude == pytest.approx(abs(z[x.cell][x.t]), abs=1e-8)
    near = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "cell long, nbr long")
    phases = spark.createDataFrame([(x.cell, x.t, x.phase) for x in got], "cell long, t long, phase double")
    for x in grid.local_coherence(phases, near, 3).where("t = 50").collect():
        assert x.r == pytest.approx(abs(np.mean([np.exp(1j * np.angle(z[c][50])) for c in range(3)])))


def fields(spark, km, degrees, trials, seed=3):
    """trial, cell, lat, lon, x, y: two independent random fields a trial."""
    lat, lon = (v.ravel() for v in np.meshgrid(np.arange(15.0, 71.0, degrees), np.arange(-75.0, -5.0, degrees), indexing="ij"))
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))], "cell long, lat double, lon double")
    made = spectral.gaussian_fields(spark, places, 2 * trials, km, seed).withColumn("trial", F.floor(F.col("number") / 2)).withColumn("side", F.col("number") % 2)
    both = made.groupBy("trial", "cell").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("y"))
    return both, places


def blocked(rows, places, km):
    blocks = spectral.spatial_blocks(places.withColumn("g", F.lit(0)), ["g"], km).select("cell", "block")
    return rows.join(blocks, "cell")


@pytest.mark.parametrize(("km", "trials", "replicates", "low", "high"), [(200.0, 60, 300, 0.005, 0.13), (600.0, 30, 200, 0.15, 1.0)])
def test_permutation_is_calibrated_unless_blocks_are_too_small(spark, km, trials, replicates, low, high):
    rows, places = fields(spark, km, 4.0, trials)
    p = [r.p for r in stats.block_permutation(blocked(rows, places, 500.0), replicates, ["trial"]).collect()]
    assert len(p) == trials and low <= np.mean(np.array(p) <= 0.05) <= high


def test_interval_covers(spark):
    rows, places = fields(spark, 200.0, 4.0, 60, 9)
    got = stats.block_bootstrap(spark, blocked(rows, places, 1500.0), 50, ["trial"]).collect()
    assert len(got) == 60 and np.mean([r.low <= 0 <= r.high for r in got]) >= 0.85
    assert all(r.boot_low < r.rho < r.boot_high for r in got[:5])


def test_strong_and_missing(spark):
    rows, places = fields(spark, 200.0, 4.0, 1)
    strong = blocked(rows.withColumn("y", F.col("x") + 0.1 * F.col("y")), places, 500.0)
    r = stats.block_permutation(strong, 500).first()
    assert r.rho > 0.9 and r.p <= 1 / 500 and r.n_blocks >= 5
    s = stats.block_bootstrap(spark, strong, 100).first()
    assert s.low > 0 and s.boot_low > 0
    gap = strong.withColumn("x", F.when(F.col("cell") >= 60, F.col("x")))
    assert stats.block_permutation(gap, 20).first().n_cells == strong.count() - 60
    few = stats.block_permutation(strong.where("cell < 3"), 20).first()
    assert (few.rho, few.p) == (None, None)


def test_ranks_over_ranges(spark):
    r = np.random.default_rng(1)
    v = [float(x) for x in r.integers(0, 30, 200)]
    df = spark.createDataFrame(list(enumerate(v)), "i long, v double").repartition(7)
    order = sorted(range(200), key=lambda i: (v[i], i))
    assert {x.i: x["rank"] for x in stats.ranked_rows(df, ["v", "i"]).collect()} == {i: k + 1 for k, i in enumerate(order)}
    got = {x.without: x.median for x in stats.jackknife_median(df, "i", "v").collect()}
    assert got == {i: float(np.median([x for j, x in enumerate(v) if j != i])) for i in range(200)}
    p = [float(x) for x in r.random(150)] + [0.5, 0.5]
    q = {x.i: x.q for x in stats.fdr(spark.createDataFrame(list(enumerate(p)), "i long, p double").repartition(5)).collect()}
    s = sorted(range(152), key=lambda i: p[i])
    best, want = 1.0, {}
    for k in range(152, 0, -1):
        best = min(best, 152 * p[s[k - 1]] / k)
        want[s[k - 1]] = best
    assert q == pytest.approx(want)
    u = stats.mann_whitney(df.withColumn("side", F.col("i") % 2), "side", 1).first()
    a, b = v[1::2], v[::2]
    assert u.u == pytest.approx(sum((x > y) + 0.5 * (x == y) for x in a for y in b)) and (u.n1, u.n2) == (100, 100)


def test_degrees_with_gaps(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(30, 20))
    x[1] = x[0] * 2 + 0.01
    x[2, :15] = np.nan
    rows = [(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    got = {c.cell: c.degree for c in grid.degree(spark.createDataFrame(rows, "cell long, values array<double>"), 0.5, 7).collect()}
    for i in range(30):
        n = 0
        for j in range(30):
            ok = ~np.isnan(x[i]) & ~np.isnan(x[j])
            n += i != j and ok.sum() >= 3 and abs(np.corrcoef(x[i][ok], x[j][ok])[0, 1]) > 0.5
        assert got[i] == n
