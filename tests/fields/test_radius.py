import numpy as np
import pytest

from tesserae.operators import grid, radius
from tesserae.queries import QUERIES


def places(seed=0):
    """Ragged rows of latitude, some over the date line, some at the poles."""
    rng = np.random.default_rng(seed)
    rows = []
    for lat in (-90.0, -89.5, -62.0, -10.0, -8.5, 0.0, 3.25, 40.0, 44.0, 71.0, 88.9, 90.0):
        for lon in sorted(rng.uniform(-180, 180, rng.integers(1, 40))):
            rows.append((len(rows), lat, float(lon)))
    return [*rows, (len(rows), 40.0, 180.0), (len(rows) + 1, 40.0, -180.0), (len(rows) + 2, 44.0, 179.9)]


@pytest.mark.parametrize("km", [150.0, 900.0, 3000.0, 12000.0])
def test_sums_equal_those_of_the_pairs(spark, km):
    rows = places()
    rng = np.random.default_rng(4)
    field = spark.createDataFrame([(c, t, None if rng.random() < 0.1 else float(rng.uniform(-3, 3))) for c, _, _ in rows for t in range(4) if rng.random() < 0.7], "cell long, t int, phase double")
    at = spark.createDataFrame(rows, "cell long, lat double, lon double")
    near = grid.neighbours(at, km)
    got = {(r.cell, r.t): r.r for r in radius.local_coherence(field, at, km).collect()}
    want = {(r.cell, r.t): r.r for r in grid.local_coherence(field.where("phase IS NOT NULL"), near).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert got[k] is None if r is None else got[k] == pytest.approx(r, abs=1e-9)
    values = field.where("t = 0").select("cell", field.phase.alias("v"))
    got = {r.cell: (r.n, r.spread) for r in radius.local_dispersion(values, at, km).collect()}
    want = {r.cell: (r.n, r.spread) for r in grid.local_dispersion(values, near).where("n >= 4").collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-7) for c in want)
    turns = field.withColumn("winding", field.phase / 3)
    got = {r.cell: r.density for r in radius.defect_density(turns, at, km).collect()}
    want = {r.cell: r.density for r in grid.defect_density(turns, near).collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-12) for c in want)


def test_rows_grow_with_latitude_rows_not_with_neighbours(spark):
    def made(columns):
        at = spark.createDataFrame([(i * columns + j, float(i), 360.0 * j / columns - 180) for i in range(6) for j in range(columns)], "cell long, lat double, lon double")
        return radius.ends(at, 400.0).count() / (6 * columns), grid.neighbours(at, 400.0).count() / (6 * columns)

    (few, pairs), (more, many) = made(60), made(480)
    assert more < few * 1.6 and many > 4 * pairs


def test_nothing(spark):
    at = spark.createDataFrame([], "cell long, lat double, lon double")
    assert radius.local_coherence(spark.createDataFrame([], "cell long, t int, phase double"), at, 500.0).count() == 0


def joined(plan):
    """Rows that the joins of a finished query's last stage gave."""
    name = plan.nodeName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name == "ResultQueryStage" else [plan.children().apply(i) for i in range(plan.children().size())]
    return sum((joined(p) for p in below), [plan.metrics().apply("numOutputRows").value()] if "Join" in name else [])


@pytest.mark.parametrize(("block", "few"), [(1024, 32), (7, 2), (1, 1)])
def test_copies_of_a_position_share_its_distances(spark, monkeypatch, block, few):
    if hasattr(grid, "BLOCK"):
        monkeypatch.setattr(grid, "BLOCK", block)
        monkeypatch.setattr(grid, "FEW", few)
    # A crowd, smaller groups around it (over the date line too), single places, one far away, one without a position.
    at = [(0.25, 179.75)] * 40 + [(0.75, 179.75)] * 12 + [(0.25, -179.75)] * 9 + [(0.25, 179.25), (-0.25, 179.75), (50.0, 10.0), (None, None)]
    rows = [(int(c), *p) for c, p in zip(np.random.default_rng(1).permutation(len(at)), at, strict=True)]
    df = grid.neighbours(spark.createDataFrame(rows, "cell long, lat double, lon double").repartition(3), 60.0)
    got = df.collect()
    km = lambda a, b: 12742 * np.arcsin(np.sqrt(np.sin(np.radians(b[1] - a[1]) / 2) ** 2 + np.cos(np.radians(a[1])) * np.cos(np.radians(b[1])) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2))
    want = {(a[0], b[0]): d for a in rows for b in rows if a[1] is not None and b[1] is not None and (d := km(a, b)) <= 60}
    assert len(got) == len(want) and {(r.cell, r.nbr): r.km for r in got} == pytest.approx(want, abs=1e-9)
    if block == 1024:  # 14 pairs of positions, 3,668 pairs of places
        assert joined(df._jdf.queryExecution().executedPlan()) == [14] and len(want) == 3668
    others = grid.neighbours(spark.createDataFrame(rows, "cell long, lat double, lon double"), 60.0, self_too=False)
    assert {(r.cell, r.nbr) for r in others.collect()} == {k for k in want if k[0] != k[1]}


def test_radius_query_rounds_before_it_makes_pairs(spark, tmp_path):
    spark.range(0, 24_000, 50).selectExpr("id AS c_custkey", "0.0D AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    df = QUERIES["c5_radius_join"](spark, str(tmp_path))
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next((i for i, x in enumerate(lines) if "Generate explode" in x), len(lines))
    assert not any("round(" in x for x in lines[:made]) and any("round(" in x for x in lines[made:])
    assert df.count() == 120 * 16 + 2 * 119 * 16  # each of 120 latitudes holds four places: itself and the rows beside it
