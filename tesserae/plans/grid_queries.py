"""Queries on gridded fields (2.B, 2.D, 2.J, 2.K)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions import kernels, scalar
from tesserae.operators import grid, radius, series, spectral
from tesserae.queries import query
from tesserae.sources.fields import customer_grid, nation_month, table, whole_months

HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
AB = HAV.format(a="a", b="b")
KM = 700.0
#: The band of the phases in months, the filter's order, and the months trimmed at both ends.
LONGEST, SHORTEST, ORDER, TRIM = 40.0, 8.0, 4, 6


def _phase_sql() -> str:
    """The chain of phases() in SQL: whole months, anomaly, detrending, the filter forward and backward over an odd continuation (by its impulse
    response, begun in the steady state of the first value), the analytic signal by the one-sided spectrum's kernel, trimmed ends."""
    sections = kernels.butterworth(ORDER, 2 / LONGEST, 2 / SHORTEST)
    up, down = np.ones(1), np.ones(1)
    for b0, b1, b2, a1, a2 in sections:
        up, down = np.polymul(up, [b0, b1, b2]), np.polymul(down, [1.0, a1, a2])
    b, a = ("[" + ", ".join(f"{x:.17g}::DOUBLE" for x in y) + "]" for y in (up, down[1:]))
    n, k = 3 * (2 * len(sections) + 1), len(down) - 1
    once = "sum(hs.h * s.{x}) - sum(CASE WHEN s.e = {end} THEN hs.s * s.{x} ELSE 0 END)"
    return f"""lim AS (SELECT (year(m) - 1995) * 12 + month(m) - 1 + CASE WHEN m = last_day(m) THEN 1 ELSE 0 END AS t FROM (SELECT CAST(max(o_orderdate) AS DATE) AS m FROM orders)),
fw AS (SELECT f.* FROM f, lim WHERE f.t < lim.t), rg AS (SELECT min(t) AS a, max(t) AS b FROM fw),
fc AS (SELECT * FROM fw WHERE cell IN (SELECT cell FROM fw GROUP BY cell HAVING count(v) = (SELECT b - a + 1 FROM rg))),
an AS (SELECT *, v - avg(v) OVER (PARTITION BY cell, month) AS a FROM fc),
dt AS (SELECT *, a - avg(a) OVER w - covar_pop(a, t) OVER w / var_pop(t) OVER w * (t - avg(t) OVER w) AS d FROM an WINDOW w AS (PARTITION BY cell)),
en AS (SELECT cell, max(CASE WHEN t = rg.a THEN d END) AS x0, max(CASE WHEN t = rg.b THEN d END) AS x1 FROM dt, rg GROUP BY cell),
xe AS (SELECT cell, t - rg.a + {n} AS e, d AS x FROM dt, rg
 UNION ALL SELECT dt.cell, {n} - (t - rg.a), 2 * x0 - d FROM dt JOIN en USING (cell), rg WHERE t - rg.a BETWEEN 1 AND {n}
 UNION ALL SELECT dt.cell, {n} + (rg.b - rg.a) + (rg.b - t), 2 * x1 - d FROM dt JOIN en USING (cell), rg WHERE rg.b - t BETWEEN 1 AND {n}),
im AS (SELECT 0 AS k, {up[0]:.17g}::DOUBLE AS h, [{up[0]:.17g}::DOUBLE, {', '.join(['0.0::DOUBLE'] * (k - 1))}] AS past
 UNION ALL SELECT k + 1, h, list_prepend(h, past[1:{k - 1}]) FROM (SELECT k, past, coalesce({b}[k + 2], 0.0) - list_dot_product({a}, past) AS h FROM im) WHERE k < 600),
hs AS (SELECT k, h, sum(h) OVER (ORDER BY k) AS s FROM im),
yf AS (SELECT t.cell, t.e, {once.format(x='x', end='0')} AS y FROM xe t JOIN xe s ON s.cell = t.cell AND s.e <= t.e JOIN hs ON hs.k = t.e - s.e GROUP BY t.cell, t.e),
yb AS (SELECT t.cell, t.e, {once.format(x='y', end=f'(SELECT {2 * n} + b - a FROM rg)')} AS y FROM yf t JOIN yf s ON s.cell = t.cell AND s.e >= t.e JOIN hs ON hs.k = s.e - t.e GROUP BY t.cell, t.e),
bp AS (SELECT cell, e - {n} + a AS t, y FROM yb, rg WHERE e BETWEEN {n} AND {n} + b - a),
gk AS (SELECT d, sum(2.0 / n * sin(2 * pi() * k * d / n)) AS g FROM (SELECT d, n, unnest(range(1, (n - 1) // 2 + 1)) AS k FROM (SELECT unnest(range(a - b, b - a + 1)) AS d, b - a + 1 AS n FROM rg)) GROUP BY d),
hb AS (SELECT t.cell, t.t, max(t.y) AS y, sum(s.y * g) AS im FROM bp t JOIN bp s ON s.cell = t.cell JOIN gk ON gk.d = t.t - s.t GROUP BY t.cell, t.t),
ph AS (SELECT dt.cell, lat_idx, lon_idx, lat, lon, dt.t, atan2(im, y) AS phase, sqrt(im * im + y * y) AS amplitude, y AS f FROM dt JOIN hb ON dt.cell = hb.cell AND dt.t = hb.t, rg WHERE dt.t - rg.a >= {TRIM} AND rg.b - dt.t >= {TRIM}),
places AS (SELECT DISTINCT cell, lat, lon FROM f),
nb AS (SELECT a.cell, b.cell AS nbr, {AB} AS km FROM places a, places b WHERE {AB} <= {KM})"""


PHASES = _phase_sql()
LOCAL = PHASES + """,
lr AS (SELECT nb.cell, ph.t, count(phase) AS n, CASE WHEN count(phase) >= 4 THEN sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)) END AS r FROM nb JOIN ph ON nb.nbr = ph.cell GROUP BY ALL)"""
MEAN = "m AS (SELECT cell, lat_idx, lon_idx, lat, lon, avg(v) AS v FROM f GROUP BY ALL)"


def _d(v: str, x: str, part: str, order: str) -> str:
    w = f"(PARTITION BY {part} ORDER BY {order})"
    up, down = f"lead({x}) OVER {w}", f"lag({x}) OVER {w}"
    return f"CASE WHEN {up} IS NOT NULL AND {down} IS NOT NULL THEN (lead({v}) OVER {w} - lag({v}) OVER {w}) / ({up} - {down}) WHEN {up} IS NOT NULL THEN (lead({v}) OVER {w} - {v}) / ({up} - {x}) WHEN {down} IS NOT NULL THEN ({v} - lag({v}) OVER {w}) / ({x} - {down}) END"


GRAD = MEAN + f", gd AS (SELECT *, {_d('v', 'lat', 'lon_idx', 'lat_idx')} AS gy, {_d('v', 'lon', 'lat_idx', 'lon_idx')} AS gx FROM m)"


def mean_field(spark, d):
    return nation_month(spark, d).groupBy("cell", "lat_idx", "lon_idx", "lat", "lon").agg(F.avg("v").alias("v"))


PLACE = ["cell", "lat_idx", "lon_idx", "lat", "lon"]


def phases(spark, d):
    """Phase and amplitude of each cell: its anomaly from the calendar months, detrended, band-passed without a shift, made analytic, the ends trimmed. Cells without every month have none."""
    rows = series.detrend(series.anomaly(whole_months(spark, d), ["cell"]), ["cell"], "a").select(*PLACE, "first", "last", "t", F.col("d").alias("v"))
    out = spectral.phase_of(rows, [*PLACE, "first", "last"], LONGEST, SHORTEST, ORDER)
    return out.where((F.col("t") - F.col("first") >= TRIM) & (F.col("last") - F.col("t") >= TRIM)).drop("first", "last")


@query("b1_wrap_lon", "cell", "east west", views="g", sql="SELECT cell, (lon * 9 + 180) - 360 * floor((lon * 9 + 180) / 360) - 180 AS west, (lon * 9 - 200) - 360 * floor((lon * 9 - 200) / 360) AS east FROM g")
def _(spark, d):
    return customer_grid(spark, d).select("cell", scalar.rotated_lon(F.col("lon") * 9, 200.0).alias("east"), scalar.wrap_lon(F.col("lon") * 9).alias("west"))


BASINS = [("north", 10.0, 60.0, -40.0, -30.0), ("wrap", 0.0, 20.0, -20.0, -35.0)]


@query("b3_basin_mask", "n", "v", "basin", views="g", ctes="bs AS (SELECT * FROM (VALUES ('north', 10.0, 60.0, -40.0, -30.0), ('wrap', 0.0, 20.0, -20.0, -35.0)) AS x(basin, s, n, w, e))", sql="SELECT basin, count(*) AS n, avg(v) AS v FROM g JOIN bs ON lat BETWEEN bs.s AND bs.n AND (CASE WHEN w <= e THEN lon BETWEEN w AND e ELSE lon >= w OR lon <= e END) GROUP BY basin")
def _(spark, d):
    g = customer_grid(spark, d)
    parts = [g.where(scalar.in_box(F.col("lat"), F.col("lon"), *box)).groupBy().agg(F.count("*").alias("n"), F.avg("v").alias("v")).withColumn("basin", F.lit(name)) for name, *box in BASINS]
    return parts[0].unionByName(parts[1]).where("n > 0")


@query("b8_cell_validity", "cell n", views="f", sql="SELECT cell, count(*) AS n FROM f GROUP BY cell HAVING count(v) > 0.75 * (SELECT count(DISTINCT t) FROM f)")
def _(spark, d):
    f = nation_month(spark, d)
    months = f.select("t").distinct().agg(F.count("*").alias("m"))
    return f.groupBy("cell").agg(F.count("v").alias("n")).crossJoin(F.broadcast(months)).where("n > 0.75 * m")


@query("b9_low_latitudes", "cell", "f", views="f", sql="SELECT DISTINCT cell, 2 * 7.2921e-5 * sin(radians(lat)) * 1e5 AS f FROM f WHERE abs(lat) >= 15")
def _(spark, d):
    return nation_month(spark, d).where(F.abs("lat") >= 15).select("cell", (scalar.coriolis(F.col("lat")) * 1e5).alias("f")).distinct()


@query("b11_edge_trim", "cell t", "v", views="f", sql="SELECT cell, t, v FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY t) AS k, count(*) OVER (PARTITION BY cell) AS n FROM f) WHERE k > 6 AND k <= n - 6")
def _(spark, d):
    o = series.ordered(["cell"])
    k, n = F.row_number().over(o), F.count("*").over(series.Window.partitionBy("cell"))
    return nation_month(spark, d).withColumn("k", k).withColumn("n", n).where("k > 6 AND k <= n - 6")


@query("c5_radius_join", "cell nbr", "km", views="g", sql=f"SELECT a.cell, b.cell AS nbr, {AB} AS km FROM g a, g b WHERE abs(a.lat - b.lat) < 1 AND {AB} <= 80.0", places=4, rounded=True)
def _(spark, d):
    return grid.neighbours(customer_grid(spark, d), 80.0, digits=4)


@query("c6_nearest", "cell nbr rank", views="f", ctes="places AS (SELECT DISTINCT cell, lat, lon FROM f)", sql=f"SELECT cell, nbr, rank FROM (SELECT a.cell, b.cell AS nbr, row_number() OVER (PARTITION BY a.cell ORDER BY round({AB}, 6), b.cell) AS rank FROM places a, places b WHERE a.cell <> b.cell AND {AB} <= 3000) WHERE rank <= 4")
def _(spark, d):
    pairs = grid.neighbours(nation_month(spark, d).select("cell", "lat", "lon").distinct(), 3000.0, self_too=False).withColumn("km", F.round("km", 6))
    o = F.row_number().over(series.Window.partitionBy("cell").orderBy("km", "nbr"))
    return pairs.withColumn("rank", o).where("rank <= 4")


@query("c7_nearest_axis", "cell place", "distance", views="g", ctes="ax AS (SELECT unnest(range(0, 60, 4)) AS place)", sql="SELECT cell, place, d AS distance FROM (SELECT cell, place, abs(lat - place) AS d, row_number() OVER (PARTITION BY cell ORDER BY abs(lat - place), place) AS k FROM g, ax) WHERE k = 1 AND d <= 4")
def _(spark, d):
    axis = spark.range(0, 60, 4).select(F.col("id").alias("place"), F.col("id").cast("double").alias("x"))
    return grid.sample_at(customer_grid(spark, d).select("cell", F.col("lat").alias("x")), axis, "cell", "place", 4.0).where("distance <= 4")


@query("c12_stencil", "cell t", "north east", views="f", sql="SELECT cell, t, lead(v) OVER (PARTITION BY t, lon_idx ORDER BY lat_idx) AS north, lead(v) OVER (PARTITION BY t, lat_idx ORDER BY lon_idx) AS east FROM f")
def _(spark, d):
    f = nation_month(spark, d)
    return f.select("cell", "t", F.lead("v").over(grid.along("lat", ["t"])).alias("north"), F.lead("v").over(grid.along("lon", ["t"])).alias("east"))


@query("d1_regrid", "lat_idx lon_idx n", "v", views="g", sql="SELECT least(floor((lat - 0.0) / 2), 29) AS lat_idx, least(floor((lon + 41.0) / 2), 12) AS lon_idx, count(v) AS n, CASE WHEN count(v) >= 4 THEN sum(cos(radians(lat)) * v) / sum(CASE WHEN v IS NOT NULL THEN cos(radians(lat)) END) END AS v FROM g WHERE lat BETWEEN 0 AND 60 AND lon BETWEEN -41 AND -15 GROUP BY ALL")
def _(spark, d):
    return grid.regrid(customer_grid(spark, d), [], 0.0, -41.0, 2.0, 30, 13)


@query("d2_box_mean", "lat_idx lon_idx n", "v", views="g", sql="SELECT least(floor(lat / 5), 11) AS lat_idx, least(floor((lon + 41.0) / 5), 5) AS lon_idx, count(v) AS n, avg(v) AS v FROM g WHERE lat BETWEEN 0 AND 60 AND lon BETWEEN -41 AND -11 GROUP BY ALL")
def _(spark, d):
    return grid.regrid(customer_grid(spark, d), [], 0.0, -41.0, 5.0, 12, 6, least=1, weighted=False)


@query("d7_regional_mean", "t", "v", views="f", sql="SELECT t, sum(cos(radians(lat)) * v) / sum(CASE WHEN v IS NOT NULL THEN cos(radians(lat)) END) AS v FROM f WHERE lat BETWEEN 14 AND 26 AND lon BETWEEN -60 AND -48 GROUP BY t")
def _(spark, d):
    return grid.box_mean(nation_month(spark, d), ["t"], scalar.in_box(F.col("lat"), F.col("lon"), 14.0, 26.0, -60.0, -48.0))


@query("d8_meridional_contrast", "year", "v", views="f", sql="SELECT year, avg(CASE WHEN lat >= 22 THEN v END) - avg(CASE WHEN lat <= 14 THEN v END) AS v FROM f GROUP BY year")
def _(spark, d):
    return nation_month(spark, d).groupBy("year").agg((F.avg(F.when(F.col("lat") >= 22, F.col("v"))) - F.avg(F.when(F.col("lat") <= 14, F.col("v")))).alias("v"))


@query("d10_order_parameter", "t n", "r", views="f", ctes=PHASES, sql="SELECT t, count(phase) AS n, sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)) AS r FROM ph GROUP BY t", places=4)
def _(spark, d):
    return grid.order_parameter(phases(spark, d), ["t"])


@query("d11_regional_phase", "t", "r angle", views="f", ctes=PHASES, sql="SELECT t, sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)) AS r, atan2(avg(sin(phase)), avg(cos(phase))) AS angle FROM ph WHERE lat <= 18 GROUP BY t HAVING count(phase) > 0", places=4)
def _(spark, d):
    return grid.order_parameter(phases(spark, d).where("lat <= 18"), ["t"]).where("n > 0")


@query("d12_phase_difference", "n", "r degrees", views="f", ctes=PHASES + """, a AS (SELECT t, atan2(avg(sin(phase)), avg(cos(phase))) AS x FROM ph WHERE lat <= 18 GROUP BY t HAVING count(phase) > 0),
b AS (SELECT t, atan2(avg(sin(phase)), avg(cos(phase))) AS y FROM ph WHERE lat > 18 GROUP BY t HAVING count(phase) > 0), c AS (SELECT atan2(sin(y - x), cos(y - x)) AS d FROM a JOIN b USING (t))""", sql="SELECT count(*) AS n, sqrt(pow(avg(cos(d)), 2) + pow(avg(sin(d)), 2)) AS r, degrees(avg(abs(d))) AS degrees FROM c")
def _(spark, d):
    p = phases(spark, d)
    a, b = (grid.order_parameter(p.where(c), ["t"]).where("n > 0").select("t", F.col("angle").alias(n)) for c, n in (("lat <= 18", "x"), ("lat > 18", "y")))
    both = a.join(b, "t").select("t", scalar.wrapped(F.col("y") - F.col("x")).alias("phase"))
    return grid.order_parameter(both.withColumn("k", F.abs("phase")), []).crossJoin(both.agg(F.degrees(F.avg(F.abs("phase"))).alias("degrees")))


@query("d16_quiescence_index", "n", "q", views="f", ctes=LOCAL + ", " + GRAD + ", mr AS (SELECT cell, avg(r) AS r FROM lr GROUP BY cell), j AS (SELECT r, sqrt(gx * gx + gy * gy) AS grad FROM mr JOIN gd USING (cell) WHERE r IS NOT NULL)", sql="SELECT count(*) AS n, -corr(r, grad) AS q FROM j")
def _(spark, d):
    r = radius.local_coherence(phases(spark, d), mean_field(spark, d), KM).groupBy("cell").agg(F.avg("r").alias("r"))
    return grid.quiescence(r, grid.gradient(mean_field(spark, d)).select("cell", "grad"))


@query("d17_standardised_product", "cell", "z", views="f", ctes=GRAD + ", zz AS (SELECT cell, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS a, (lat - avg(lat) OVER ()) / stddev_pop(lat) OVER () AS b FROM gd)", sql="SELECT cell, a * b AS z FROM zz")
def _(spark, d):
    w = series.Window.partitionBy(F.lit(1))  # the cells of one mean field
    return mean_field(spark, d).select("cell", (scalar.zscore(F.col("v"), w) * scalar.zscore(F.col("lat"), w)).alias("z"))


@query("d20_gradient_energy", "year", "e", views="f", ctes=f"m AS (SELECT year, cell, lat_idx, lon_idx, lat, lon, avg(v) AS v FROM f GROUP BY ALL), gd AS (SELECT *, {_d('v', 'lat', 'year, lon_idx', 'lat_idx')} AS gy, {_d('v', 'lon', 'year, lat_idx', 'lon_idx')} AS gx FROM m)", sql="SELECT year, avg(gx * gx + gy * gy) AS e FROM gd GROUP BY year")
def _(spark, d):
    m = nation_month(spark, d).groupBy("year", "cell", "lat_idx", "lon_idx", "lat", "lon").agg(F.avg("v").alias("v"))
    return grid.gradient(m, ["year"]).groupBy("year").agg(F.avg(F.col("grad") * F.col("grad")).alias("e"))


@query("d21_site_lattice", "la lo n", views="g", sql="SELECT floor(lat / 5) * 5 AS la, floor(lon / 5) * 5 AS lo, count(*) AS n FROM g GROUP BY ALL")
def _(spark, d):
    return customer_grid(spark, d).groupBy((F.floor(F.col("lat") / 5) * 5).alias("la"), (F.floor(F.col("lon") / 5) * 5).alias("lo")).agg(F.count("*").alias("n"))


@query("j1_local_coherence", "cell t", "r", views="f", ctes=LOCAL, sql="SELECT cell, t, r FROM lr", places=4)
def _(spark, d):
    return radius.local_coherence(phases(spark, d), mean_field(spark, d), KM)


@query("j2_square_coherence", "t lat_idx lon_idx n", "r", views="f", ctes=PHASES + ", k AS (SELECT unnest(range(-1, 2)) AS k), sq AS (SELECT t, (lat_idx + a.k + 5) % 5 AS lat_idx, (lon_idx + b.k + 5) % 5 AS lon_idx, phase FROM ph, k a, k b)", sql="SELECT t, lat_idx, lon_idx, count(phase) AS n, sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)) AS r FROM sq GROUP BY ALL", places=4)
def _(spark, d):
    return grid.square_coherence(phases(spark, d), 5, 5)


FREQ = """fs AS (SELECT cell, t, phase - lag(phase) OVER (PARTITION BY cell ORDER BY t) AS s FROM ph),
fu AS (SELECT cell, t, sum(coalesce(atan2(sin(s), cos(s)), 0)) OVER (PARTITION BY cell ORDER BY t ROWS UNBOUNDED PRECEDING) AS u FROM fs),
fg AS (SELECT cell, coalesce((lead(u) OVER w - lag(u) OVER w) / 2, lead(u) OVER w - u, u - lag(u) OVER w) AS g FROM fu WINDOW w AS (PARTITION BY cell ORDER BY t)),
om AS (SELECT cell, avg(g) * 12 / (2 * pi()) AS v FROM fg GROUP BY cell)"""


@query("j3_frequency_dispersion", "cell n", "spread", views="f", ctes=PHASES + ", " + FREQ, sql="SELECT nb.cell, count(v) AS n, stddev_pop(v) AS spread FROM nb JOIN om ON nb.nbr = om.cell GROUP BY nb.cell HAVING count(v) >= 4")
def _(spark, d):
    omega = series.frequency(phases(spark, d), ["cell"], 12).withColumnRenamed("omega", "v")
    return radius.local_dispersion(omega, mean_field(spark, d), KM)


WIND = PHASES + """, e1 AS (SELECT *, CASE WHEN lead(lon_idx) OVER w = lon_idx + 1 THEN lead(phase) OVER w END AS se FROM ph WINDOW w AS (PARTITION BY t, lat_idx ORDER BY lon_idx)),
n1 AS (SELECT *, CASE WHEN lead(lat_idx) OVER w = lat_idx + 1 THEN lead(phase) OVER w END AS nw, CASE WHEN lead(lat_idx) OVER w = lat_idx + 1 THEN lead(se) OVER w END AS ne FROM e1 WINDOW w AS (PARTITION BY t, lon_idx ORDER BY lat_idx)),
wd AS (SELECT cell, t, (atan2(sin(se - phase), cos(se - phase)) + atan2(sin(ne - se), cos(ne - se)) + atan2(sin(nw - ne), cos(nw - ne)) + atan2(sin(phase - nw), cos(phase - nw))) / (2 * pi()) AS winding FROM n1)"""


@query("j4_winding", "cell t", "winding", views="f", ctes=WIND, sql="SELECT * FROM wd", places=4)
def _(spark, d):
    return grid.winding(phases(spark, d))


@query("j5_defect_density", "cell", "density", views="f", ctes=WIND + ", pd AS (SELECT nb.cell, t, count(*) AS n, avg(CASE WHEN abs(winding) >= 0.5 THEN 1.0 ELSE 0.0 END) AS dd FROM nb JOIN wd ON nb.nbr = wd.cell WHERE winding IS NOT NULL GROUP BY ALL HAVING count(*) >= 4)", sql="SELECT cell, avg(dd) AS density FROM pd GROUP BY cell")
def _(spark, d):
    return radius.defect_density(grid.winding(phases(spark, d)), mean_field(spark, d), KM)


@query("j7_network_degree", "cell degree", views="f", ctes="r AS (SELECT a.cell, b.cell AS other, corr(a.v, b.v) AS r FROM f a JOIN f b ON a.t = b.t AND a.cell <> b.cell GROUP BY ALL HAVING count(*) >= 3 AND var_pop(a.v) > 0 AND var_pop(b.v) > 0)", sql="SELECT c.cell, count(*) FILTER (abs(r) > 0.2) AS degree FROM (SELECT DISTINCT cell FROM f) c LEFT JOIN r ON c.cell = r.cell GROUP BY c.cell")
def _(spark, d):
    f = nation_month(spark, d)
    months = f.select("t").distinct().agg(F.array_sort(F.collect_list("t")).alias("ts"))  # the field's months, one row
    rows = f.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("x")).crossJoin(F.broadcast(months))
    return grid.degree(rows.select("cell", F.transform("ts", lambda t: F.try_element_at("x", t)).alias("values")), 0.2)


@query("j8_tile_condition", "ti tj n", "kappa", views="g", sql="SELECT floor(lat / 10) AS ti, floor(lon / 10) AS tj, count(v) AS n, ((count(v) + sum(x * x)) / 2 + sqrt(pow((count(v) - sum(x * x)) / 2, 2) + sum(x) * sum(x))) / ((count(v) + sum(x * x)) / 2 - sqrt(pow((count(v) - sum(x * x)) / 2, 2) + sum(x) * sum(x))) AS kappa FROM (SELECT *, v / 1e4 AS x FROM g) GROUP BY ALL HAVING count(v) >= 12")
def _(spark, d):
    return grid.tile_condition(customer_grid(spark, d).withColumn("v", F.col("v") / 1e4))


@query("k1_gradient", "cell", "gx gy grad", views="f", ctes=GRAD, sql="SELECT cell, gx, gy, sqrt(gx * gx + gy * gy) AS grad FROM gd")
def _(spark, d):
    return grid.gradient(mean_field(spark, d))


def _eke_sql(edge: str) -> str:
    m = "1.1119492664455873e5"
    return f"""h AS (SELECT *, v - avg(v) OVER (PARTITION BY cell) AS a FROM f), uv AS (SELECT cell, lat,
 CASE WHEN lead(lat) OVER n IS NOT NULL AND lag(lat) OVER n IS NOT NULL THEN -9.81 / (2 * 7.2921e-5 * sin(radians(lat))) * (lead(a) OVER n - lag(a) OVER n) / ((lead(lat) OVER n - lag(lat) OVER n) * {m}) ELSE {edge} END AS u,
 CASE WHEN lead(lon) OVER e IS NOT NULL AND lag(lon) OVER e IS NOT NULL THEN 9.81 / (2 * 7.2921e-5 * sin(radians(lat))) * (lead(a) OVER e - lag(a) OVER e) / ((lead(lon) OVER e - lag(lon) OVER e) * {m} * cos(radians(lat))) ELSE {edge} END AS w
 FROM h WINDOW n AS (PARTITION BY t, lon_idx ORDER BY lat_idx), e AS (PARTITION BY t, lat_idx ORDER BY lon_idx))"""


@query("k2_eddy_energy", "cell", "eke", views="f", ctes=_eke_sql("0.0"), sql="SELECT cell, avg(0.5 * (u * u + w * w)) AS eke FROM uv WHERE abs(lat) >= 15 GROUP BY cell")
def _(spark, d):
    return grid.eddy_energy(nation_month(spark, d))


@query("k2_eddy_energy_missing_edges", "cell", "eke", views="f", ctes=_eke_sql("NULL"), sql="SELECT cell, avg(0.5 * (u * u + w * w)) AS eke FROM uv WHERE abs(lat) >= 15 GROUP BY cell")
def _(spark, d):
    return grid.eddy_energy(nation_month(spark, d), edges_zero=False)


@query("k4_morans_i", "n", "moran n_eff", views="f", ctes=MEAN + f""", z AS (SELECT cell, lat, lon, v - (SELECT avg(v) FROM m) AS z FROM m),
kn AS (SELECT a.cell, b.z, row_number() OVER (PARTITION BY a.cell ORDER BY round({AB}, 9), b.cell) AS k FROM z a, z b WHERE a.cell <> b.cell), lg AS (SELECT cell, avg(z) AS l FROM kn WHERE k <= 24 GROUP BY cell)""", sql="SELECT count(*) AS n, sum(z * l) / sum(z * z) AS moran, count(*) * (1 - sum(z * l) / sum(z * z)) / (1 + sum(z * l) / sum(z * z)) AS n_eff FROM z JOIN lg USING (cell)")
def _(spark, d):
    return grid.morans_i(mean_field(spark, d), 24, 9000.0)


@query("k5_trend_map", "cell", "trend present", views="f", ctes="mo AS (SELECT DISTINCT year, month FROM f), mx AS (SELECT avg(year + (month - 0.5) / 12) AS mx, count(*) AS months FROM mo), r AS (SELECT cell, year + (month - 0.5) / 12 - mx AS dx, v - avg(v) OVER (PARTITION BY cell) AS dv, months FROM f, mx)", sql="SELECT cell, sum(dx * dv) / sum(dx * dx) * 100 AS trend, count(*) / max(months) AS present FROM r GROUP BY cell HAVING count(*) > 0.75 * max(months)", places=5)
def _(spark, d):
    return grid.trend_map(nation_month(spark, d))


@query("k6_bilinear", "id", "v", views="f", ctes=MEAN + ", tg AS (SELECT s_suppkey AS id, 10 + (s_suppkey % 33) / 2.0 AS lat, -60 + (s_suppkey * 7 % 33) / 2.0 AS lon FROM supplier), fl AS (SELECT id, CAST(floor((lat - 10) / 4) AS INT) AS i, CAST(floor((lon + 60) / 4) AS INT) AS j, (lat - 10) / 4 - floor((lat - 10) / 4) AS fy, (lon + 60) / 4 - floor((lon + 60) / 4) AS fx FROM tg), co AS (SELECT id, i + a AS lat_idx, j + b AS lon_idx, (CASE WHEN a = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN b = 1 THEN fx ELSE 1 - fx END) AS w FROM fl, (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b))", sql="SELECT id, CASE WHEN count(v) = count(*) THEN sum(w * v) END AS v FROM co LEFT JOIN m ON co.lat_idx = m.lat_idx AND co.lon_idx = m.lon_idx WHERE w > 0 GROUP BY id")
def _(spark, d):
    targets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (10 + (F.col("s_suppkey") % 33) / 2.0).alias("lat"), (-60 + (F.col("s_suppkey") * 7 % 33) / 2.0).alias("lon"))
    return grid.bilinear(mean_field(spark, d), targets, 10.0, -60.0, 4.0)


@query("k7_wind_curl", "cell", "magnitude curl", views="f", ctes=f"m AS (SELECT cell, lat_idx, lon_idx, lat, lon, avg(v) AS tx, max(v) AS ty FROM f GROUP BY ALL), c AS (SELECT *, {_d('ty', 'lon', 'lat_idx', 'lon_idx')} AS a, {_d('tx', 'lat', 'lon_idx', 'lat_idx')} AS b FROM m)", sql="SELECT cell, sqrt(tx * tx + ty * ty) AS magnitude, (a / (1.1119492664455873e5 * cos(radians(lat))) - b / (1.1119492664455873e5)) * 1e6 AS curl FROM c")
def _(spark, d):
    m = nation_month(spark, d).groupBy("cell", "lat_idx", "lon_idx", "lat", "lon").agg(F.avg("v").alias("tx"), F.max("v").alias("ty"))
    return grid.curl(m, []).withColumn("curl", F.col("curl") * 1e6)


@query("h5_haversine", "a b", "km", views="f", ctes="places AS (SELECT DISTINCT cell, lat, lon FROM f)", sql=f"SELECT a.cell AS a, b.cell AS b, {AB} AS km FROM places a JOIN places b ON b.cell = a.cell + 1")
def _(spark, d):
    p = nation_month(spark, d).select("cell", "lat", "lon").distinct()
    q = p.select(F.col("cell").alias("b"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    return p.join(q, F.col("b") == F.col("cell") + 1).select(F.col("cell").alias("a"), "b", scalar.haversine_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")).alias("km"))


@query("h7_cell_area", "cell", "area f", views="f", sql="SELECT DISTINCT cell, 16 * cos(radians(lat)) * pow(6371.0 * pi() / 180, 2) AS area, 2 * 7.2921e-5 * sin(radians(lat)) * 1e6 AS f FROM f")
def _(spark, d):
    return nation_month(spark, d).select("cell", scalar.cell_area_km2(F.col("lat"), 4.0, 4.0).alias("area"), (scalar.coriolis(F.col("lat")) * 1e6).alias("f")).distinct()
