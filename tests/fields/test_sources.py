import json

import pytest
from pyspark.sql import functions as F

from tesserae.sources import files


def test_monthly_grids_and_size(spark, tmp_path):
    for ym in (199912, 200001, 200002):
        spark.createDataFrame([(ym, 1.0)], "t long, v double").coalesce(1).write.parquet(f"{tmp_path}/raw{ym}")
        part = next(p for p in (tmp_path / f"raw{ym}").iterdir() if p.suffix == ".parquet")
        (tmp_path / "grids").mkdir(exist_ok=True)
        part.rename(tmp_path / "grids" / f"sst_{ym}.parquet")
    df = files.monthly_grids(spark, f"{tmp_path}/grids", 200001, 200012)
    assert sorted((r.t, r.ym) for r in df.collect()) == [(200001, 200001), (200002, 200002)]
    assert files.large_enough(spark.read.parquet(f"{tmp_path}/grids"), 10**6).count() == 0


def test_text_tables(spark, tmp_path):
    (tmp_path / "nao.txt").write_text("a header line\n 1950 " + " ".join(str(i) for i in range(12)) + "\n1951 " + "-99.9 " * 11 + "5\n1952 1 2\n")
    got = {(r.year, r.month): r.v for r in files.yearly_table(spark, f"{tmp_path}/nao.txt").collect()}
    assert len(got) == 24 and got[1950, 12] == 11.0 and got[1951, 1] is None and got[1951, 12] == 5.0
    (tmp_path / "core.tab").write_text("/* DATA\nmany words\n*/\nDepth sed [m]\tAge [ka BP]\tSS avg [um]\n0.1\t0.05\t12.5\n0.2\t0.10\t\n")
    core = sorted(files.core_table(spark, f"{tmp_path}/core.tab").collect(), key=lambda r: r.depth)
    assert [(r.year, r.v) for r in core] == [(1900.0, 12.5), (1850.0, None)]
    (tmp_path / "proxy.csv").write_text("year,value\n1900,1.5\n-5,2\nx,y\n1901,\n")
    assert [(r.year, r.v) for r in files.proxy_table(spark, f"{tmp_path}/proxy.csv").collect()] == [(1900.0, 1.5)]


def test_documents(spark, tmp_path):
    d = tmp_path / "v"
    d.mkdir()
    (d / "p6_verdict_a0o0.json").write_text(json.dumps({"Q_X": 0.27, "verdict": "falsified", "n_cells": 1045}, indent=1))
    (d / "p6_verdict_smoke.json").write_text('{"verdict": "deferred", "reason": "drift", "drift_K_per_year": 0.5}')
    (d / "p6_verdict_bad.json").write_text("{not json")
    got = {r.tag: (r.verdict, r.Q_X, r.reason) for r in files.verdicts(spark, str(d)).collect()}
    assert got == {"a0o0": ("falsified", 0.27, None), "smoke": ("deferred", None, "drift")}
    c = tmp_path / "c"
    c.mkdir()
    (c / "m.json").write_text('{"model": "m", "pi_p95_threshold": 0.4, "hist_Q": [0.1, 0.2], "hist_centres": [1900, 1930]}')
    (c / "n.json").write_text('{"model": "n"}')
    assert sorted((r.model, r.centre, r.q) for r in files.corridor_documents(spark, str(c)).collect()) == [("m", 1900, 0.1), ("m", 1930, 0.2)]
    log = tmp_path / "run.log"
    log.write_text("start\nopen r1i1\n1850-1879: Q = 0.31 (n=1)\n1880-1909: Q = -0.2\nopen r2i1\n1850-1879: Q = 1e-1\n")
    assert sorted((r.member, r.start, r.q) for r in files.run_log(spark, str(log)).collect()) == [("r1i1", 1850, 0.31), ("r1i1", 1880, -0.2), ("r2i1", 1850, 0.1)]


def test_normalised_and_products(spark):
    df = spark.createDataFrame([(1.0, float("nan"), 5)], "latitude double, uwnd double, k int")
    row = files.normalised(df, required=["lat", "u"]).first()
    assert (row.lat, row.u, row.k) == (1.0, None, 5)
    with pytest.raises(ValueError, match="missing"):
        files.normalised(df, required=["lon"])
    with pytest.raises(ValueError, match="unknown"):
        files.product(spark.createDataFrame([("a",)], "product string"), "b")


def test_pixels_cover_the_sphere_evenly(spark):
    p = files.pixel_lookup(spark, 4).toPandas()
    assert len(p) == 192 and p.lat.abs().max() < 90 and p.lon.between(0, 360).all()
    assert abs(p.lat.mean()) < 1e-9 and abs(__import__("numpy").sin(__import__("numpy").radians(p.lat)).mean()) < 1e-12
    assert p[["lat", "lon"]].round(6).drop_duplicates().shape[0] == 192
    assert p.groupby(p.lat.round(6)).size().tolist() == [4, 8, 12, 16, *[16] * 7, 16, 12, 8, 4]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("sst", 2000, 1.0), ("sst", 2001, float("nan")), ("ssh", 2000, None)], "field string, year int, v double")
    files.write_field(df, f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").where("year = 2000").count() == 2
    files.write_documents(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").where("v IS NOT NULL").count() == 1
    files.write_summary(df.where("v IS NULL"), f"{tmp_path}/s", ["year", "field", "v"])
    assert spark.read.text(f"{tmp_path}/s").where(F.col("value") == "2000,ssh,").count() == 1
    assert files.markdown(df.where("v IS NULL"), ["field", "v"]).first().line == "| ssh |  |"
