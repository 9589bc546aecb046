"""Operators that replace all pairs or whole groups in one task: against the plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import tesserae.__main__ as command
from tesserae.operators import spectral, stats


def patches(cells):
    """The largest summed area of edge-connected cells."""
    left, best = dict(cells), 0.0
    while left:
        todo, total = [next(iter(left))], 0.0
        while todo:
            i, j = todo.pop()
            if (a := left.pop((i, j), None)) is not None:
                total += a
                todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        best = max(best, total)
    return best


@pytest.mark.parametrize("strip", [1, 3, 256])
def test_patches_over_strips(spark, strip):
    rng = np.random.default_rng(strip)
    fields = {g: {(int(i), int(j)): float(rng.integers(1, 9)) for i in range(-7, 13) for j in range(15) if rng.random() < share} for g, share in enumerate((0.3, 0.6, 0.9))}
    # A snake that goes over every strip again and again.
    fields[3] = {(i, j): 1.0 for j in range(0, 14) for i in (range(-7, 13) if j % 2 == 0 else ([12] if j % 4 == 1 else [-7]))}
    rows = [(g, i, j, a) for g, cells in fields.items() for (i, j), a in cells.items()]
    df = spark.createDataFrame(rows, "year int, lat_idx int, lon_idx int, area double").repartition(5)
    got = {r.year: r.area for r in spectral.largest_patches(df, ["year"], strip).collect()}
    assert got == pytest.approx({g: patches(cells) for g, cells in fields.items()})
    assert spectral.largest_patches(df.limit(0), ["year"], strip).count() == 0


def scan(places, km):
    """Greedy blocks by one scan, distances by vectors."""
    unit = {c: np.array([np.cos(np.radians(a)) * np.cos(np.radians(o)), np.cos(np.radians(a)) * np.sin(np.radians(o)), np.sin(np.radians(a))]) for c, a, o in places}
    seeds, out = [], {}
    for c in sorted(unit):
        d = [6371.0 * np.arctan2(np.linalg.norm(np.cross(unit[c], unit[s])), unit[c] @ unit[s]) for s in seeds]
        if d and min(d) <= km / 2:
            out[c] = int(np.argmin(d))
        else:
            out[c] = len(seeds)
            seeds.append(c)
    return out


@pytest.mark.parametrize("strip", [1.0, 1500.0, 50_000.0])
def test_blocks_over_strips_are_the_scans(spark, strip):
    rng = np.random.default_rng(int(strip))
    every = []
    for g in range(3):
        at = [(float(a), float(o)) for a in np.arange(-40.0, 41.0, 4.0) for o in np.arange(0.0, 60.0, 5.0)] if g < 2 else [(float(np.degrees(np.arcsin(z))), float(o)) for z, o in zip(rng.uniform(-1, 1, 200), rng.uniform(-180, 180, 200), strict=True)]
        at = [(a + rng.uniform(-0.01, 0.01), o) for a, o in at]  # no two distances are equal
        order = range(len(at)) if g == 0 else rng.permutation(len(at))
        every += [(g, int(c), a, o) for c, (a, o) in zip(order, at, strict=True)]
    df = spark.createDataFrame(every, "basin int, cell long, lat double, lon double").repartition(4)
    got = {(r.basin, r.cell): r.block for r in spectral.spatial_blocks(df, ["basin"], 1700.0, strip).collect()}
    for g in range(3):
        want = scan([r[1:] for r in every if r[0] == g], 1700.0)
        assert {c: b for (basin, c), b in got.items() if basin == g} == want


def test_random_fields_have_their_covariance(spark):
    places = [(i, 20.0 + 2 * (i // 6), -40.0 + 2 * (i % 6)) for i in range(36)]
    df = spark.createDataFrame(places, "cell long, lat double, lon double")
    x = np.zeros((400, 36))
    for r in spectral.gaussian_fields(spark, df, 400, 300.0, 5).collect():
        x[r.number, r.cell] = r.v
    assert x.mean(1) == pytest.approx(0, abs=1e-9) and x.std(1) == pytest.approx(1)
    a, o = (np.radians([p[k] for p in places]) for k in (1, 2))
    xyz = 6371.0 * np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])
    d2 = ((xyz[:, :, None] - xyz[:, None]) ** 2).sum(0)
    seen, want = np.corrcoef(x.T), np.exp(-d2 / (2 * 300.0**2))
    middle = (np.eye(36) - 1 / 36)
    want = middle @ want @ middle  # standardised fields have no mean of their own
    want /= np.sqrt(np.outer(np.diag(want), np.diag(want)))
    assert np.abs(seen - want).max() < 0.25 and np.abs(seen - want).mean() < 0.05
    again = spectral.gaussian_fields(spark, df.where("cell < 18").repartition(3), 2, 300.0, 5)
    assert again.count() == 36
    assert abs(np.corrcoef(x[:200].ravel(), x[200:].ravel())[0, 1]) < 0.05


def test_exceedance(spark):
    rng = np.random.default_rng(0)
    control, seen = rng.integers(0, 50, 300).astype(float), rng.integers(-3, 53, 80).astype(float)
    df = stats.exceedance(spark.createDataFrame([(float(v),) for v in control] + [(None,)], "v double").repartition(4), spark.createDataFrame([(f"n{i}", float(x)) for i, x in enumerate(seen)], "name string, x double"))
    got = {r.name: (r.share, r.verdict) for r in df.collect()}
    for i, x in enumerate(seen):
        share = (control <= x).mean()
        assert got[f"n{i}"] == (pytest.approx(share), "detected" if share <= 0.01 else "likely" if share <= 0.05 else "within")


def test_density_and_exit(spark):
    rng = np.random.default_rng(1)
    x, y = np.r_[rng.normal(0, 1, 250), rng.normal(30, 2, 50)], np.r_[rng.normal(5, 3, 250), rng.normal(-40, 1, 50)]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t int, x double, y double")
    h = 0.2
    k = lambda a, b: np.exp(-0.5 * (((a[:, None] - x) / (x.std(ddof=1) * h)) ** 2 + ((b[:, None] - y) / (y.std(ddof=1) * h)) ** 2))
    at = np.array([(a, b) for a in (-2.0, 0.0, 15.0, 30.0) for b in (-40.0, 5.0, 1e6)])
    got = {(r.gx, r.gy): r.density for r in stats.density(points, spark.createDataFrame([tuple(map(float, p)) for p in at], "gx double, gy double"), h).collect()}
    want = k(at[:, 0], at[:, 1]).mean(1) / (2 * np.pi * x.std(ddof=1) * y.std(ddof=1) * h**2)
    assert [got[tuple(p)] for p in at] == pytest.approx(want, abs=2e-8)
    d = k(x, y).mean(1)
    r = stats.exit_fraction(points, h, 0.1).first()
    assert (r.n, r.outside) == (300, (d < np.quantile(d, 0.1)).sum()) and r.level == pytest.approx(np.quantile(d, 0.1), abs=2e-8)


def test_command_line(spark, tmp_path, capsys):
    assert command.main(["--list"]) == 0 and "k5_trend_map" in capsys.readouterr().out
    assert command.main(["--sql", "h7_"]) == 0 and "SELECT" in capsys.readouterr().out
    assert command.main(["nothing_like_it", "--tables", "x"]) == 2 and command.main([]) == 2
    spark.createDataFrame([(1, 5.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert command.main(["b1_", "--tables", str(tmp_path), "--out", f"{tmp_path}/out", "--format", "json"]) == 0
    assert spark.read.json(f"{tmp_path}/out/b1_wrap_lon").count() == 1
    assert "tesserae/queries.py" in __import__("zipfile").ZipFile(command.packed()).namelist()
