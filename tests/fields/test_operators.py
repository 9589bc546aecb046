import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import scalar
from tesserae.operators import grid, series, stats


def km(a, b):
    (y1, x1), (y2, x2) = (np.radians(p) for p in (a, b))
    h = np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(h, 1)))


@pytest.mark.parametrize("radius", [150.0, 900.0, 4000.0])
def test_neighbours_everywhere(spark, radius):
    r = np.random.default_rng(int(radius))
    places = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(np.degrees(np.arcsin(r.uniform(-1, 1, 120))), r.uniform(-180, 180, 120), strict=True))]
    places += [(200, 89.9, 10.0), (201, 89.9, -170.0), (202, -90.0, 0.0), (203, -89.5, 120.0), (204, 0.0, 179.9), (205, 0.1, -179.9), (206, 60.0, 180.0), (207, 60.2, -179.5)]
    got = {(x.cell, x.nbr) for x in grid.neighbours(spark.createDataFrame(places, "cell long, lat double, lon double"), radius).collect()}
    assert got == {(a[0], b[0]) for a in places for b in places if km(a[1:], b[1:]) <= radius}


def test_regrid_of_a_smooth_field(spark):
    native = spark.range(200 * 300).select((0.5 + F.floor(F.col("id") / 300) * (74.0 / 199)).alias("lat"), (-79.5 + F.col("id") % 300 * (79.0 / 299)).alias("lon"))
    native = native.withColumn("v", F.when(F.col("lat") >= 5, F.sin(F.col("lat") / 20) * F.cos(F.col("lon") / 30)))
    out = grid.regrid(native, [], 0.0, -80.0, 2.0, 38, 40).collect()
    for r in out:
        y, x = 1 + 2 * r.lat_idx, -79 + 2 * r.lon_idx
        if r.lat_idx < 2:
            assert r.v is None
        elif 3 < r.lat_idx < 35 and 2 < r.lon_idx < 38:
            assert abs(r.v - math.sin(y / 20) * math.cos(x / 30)) < 0.01
    edge = spark.createDataFrame([(76.0, 0.0, 1.0), (76.5, 0.0, 9.0)], "lat double, lon double, v double")
    assert [(r.lat_idx, r.lon_idx, r.n) for r in grid.regrid(edge, [], 0.0, -80.0, 2.0, 38, 40, least=1).collect()] == [(37, 39, 1)]


def test_vortex_has_one_winding(spark):
    n = 12
    rows = [(0, i, j, i * n + j, math.atan2(i - 5.5, j - 5.5)) for i in range(n) for j in range(n)]
    w = grid.winding(spark.createDataFrame(rows, "t int, lat_idx int, lon_idx int, cell int, phase double"))
    assert w.agg(F.sum("winding")).first()[0] == pytest.approx(1) and w.where("abs(winding) > 0.5").count() == 1
    smooth = [(0, i, j, i * n + j, 0.1 * i + 0.05 * j) for i in range(n) for j in range(n)]
    assert grid.winding(spark.createDataFrame(smooth, "t int, lat_idx int, lon_idx int, cell int, phase double")).agg(F.max(F.abs("winding"))).first()[0] == pytest.approx(0)


def test_missing_and_constant(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 3.0), (3, 1.0, None), (4, None, 9.0)], "t int, x double, y double")
    assert df.agg(scalar.safe_corr(F.col("x"), F.col("y"))).first()[0] is None
    v = spark.createDataFrame([(float("nan"),), (-100.0,), (3.0,), (None,)], "v double")
    assert [r[0] for r in v.select(scalar.masked(F.col("v"), -99.0)).collect()] == [None, None, 3.0, None]
    lon = spark.createDataFrame([(-181.0,), (180.0,), (540.0,), (-180.0,)], "x double")
    assert [r[0] for r in lon.select(scalar.wrap_lon(F.col("x"))).collect()] == [179.0, -180.0, -180.0, -180.0]


def test_crossings_at_the_end(spark):
    rows = [("a", t, v) for t, v in enumerate([0, 1, 1, 0, 1, 1, 1])]
    df = spark.createDataFrame(rows, "g string, t int, v int")
    assert series.first_crossing(df, ["g"], F.col("v") > 0, 3).first()["first"] is None
    assert series.first_crossing(df, ["g"], F.col("v") > 0, 3, strict=False).first()["first"] == 4
    assert series.strict_exit(df, ["g"], F.lit(0.5), F.lit(0.1)).first()["exit"] == 4


def test_interpolation_and_windows(spark):
    s = spark.createDataFrame([("c", 0.0, 1.0), ("c", 10.0, 3.0), ("c", 10.0, 9.0), ("c", 30.0, 5.0)], "core string, age double, v double")
    assert sorted((r.at, r.v) for r in series.interpolated(s, ["core"], 5, 0, 100).collect()) == [(0, 1.0), (5, 2.0), (10, 3.0), (15, 3.5), (20, 4.0), (25, 4.5), (30, 5.0)]
    f = spark.createDataFrame([("m", y, m, float(y)) for y in range(1990, 2000) for m in range(1, 13) if not (y == 1999 and m > 2)], "g string, year int, month int, v double")
    w = {r.start: r["mean"] for r in series.windows(f, ["g"], 3, 2, 1990, 1999).collect()}
    assert w == {1990: 1991.0, 1992: 1993.0, 1994: 1995.0, 1996: 1997.0}


def test_fdr_and_trend(spark):
    p = [0.01, 0.04, 0.03, None, 0.5, 0.03]
    got = {r.i: r.q for r in stats.fdr(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    assert got[0] == pytest.approx(0.05) and got[2] == got[5] == pytest.approx(0.05) and got[1] == pytest.approx(0.05) and got[4] == 0.5 and got[3] is None
    s = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate([1, 2, 2, 5, 4])], "g string, t int, v double")
    r = stats.mann_kendall(s, ["g"]).first()
    assert r.s == 7 and r["var"] == pytest.approx((5 * 4 * 15 - 2 * 1 * 9) / 18) and r.z == pytest.approx(6 / math.sqrt(r["var"]))


def test_bootstrap_blocks_wrap(spark):
    x = spark.createDataFrame([(i, float(i)) for i in range(10)], "i long, v double")
    rows = stats.resampled(spark, x, 5, 4).collect()
    assert len(rows) == 50
    for r in rows:
        first = next(q for q in rows if q.replicate == r.replicate and q.place == r.place // 4 * 4)
        assert r.i == (first.i + r.place % 4) % 10
