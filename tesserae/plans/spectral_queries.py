"""Queries by per-series kernels and composite decisions (2.I, 2.J, 2.K, 2.L, 2.M, 2.N). Where SQL can't say their kernels, tests hold them to known signals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions import kernels
from tesserae.functions.scalar import EARTH_KM, cell_area_km2
from tesserae.operators import grid, radius, series, spectral, stats
from tesserae.plans import decide
from tesserae.plans.grid_queries import AB, GRAD, KM, LOCAL, LONGEST, MEAN, PHASES, PLACE, SHORTEST, mean_field, phases
from tesserae.plans.stats_queries import DRAW
from tesserae.plans.regression_queries import t_p_sql
from tesserae.queries import query
from tesserae.sources.fields import events_hour, nation_month, segment_month, ship_month, whole_months


def detrended(spark, d):
    """The anomalies that the phases are made of: cells with every month only."""
    rows = series.detrend(series.anomaly(whole_months(spark, d), ["cell"]), ["cell"], "a")
    return rows.select(*PLACE, "first", "last", "t", F.col("d").alias("v"))


def zero_phase_sql(source: str, sections) -> str:
    """Low-pass of each series of source (key, t, x) forward and backward in SQL, as lp (key, t, f): over an odd continuation, by the filter's impulse response, begun in the steady state of the first value."""
    up, down = np.ones(1), np.ones(1)
    for b0, b1, b2, a1, a2 in sections:
        up, down = np.polymul(up, [b0, b1, b2]), np.polymul(down, [1.0, a1, a2])
    b, a = ("[" + ", ".join(f"{x:.17g}::DOUBLE" for x in y) + "]" for y in (up, down[1:]))
    n, k = 3 * (2 * len(sections) + 1), len(down) - 1
    once = "sum(ls.h * s.{x}) - sum(CASE WHEN s.e = {end} THEN ls.u * s.{x} ELSE 0 END) + max(g.g) * max({first})"
    return f"""li AS (SELECT key, t, x, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM {source}),
le AS (SELECT key, max(CASE WHEN i = 0 THEN x END) AS x0, max(CASE WHEN i = n - 1 THEN x END) AS x1 FROM li GROUP BY key),
lx AS (SELECT key, n, i + {n} AS e, x FROM li UNION ALL SELECT li.key, n, {n} - i, 2 * x0 - x FROM li JOIN le ON li.key = le.key WHERE i BETWEEN 1 AND {n}
 UNION ALL SELECT li.key, n, {n} + n - 1 + (n - 1 - i), 2 * x1 - x FROM li JOIN le ON li.key = le.key WHERE n - 1 - i BETWEEN 1 AND {n}),
lm AS (SELECT 0 AS k, {up[0]:.17g}::DOUBLE AS h, [{up[0]:.17g}::DOUBLE, {', '.join(['0.0::DOUBLE'] * (k - 1))}] AS past
 UNION ALL SELECT k + 1, h, list_prepend(h, past[1:{k - 1}]) FROM (SELECT k, past, coalesce({b}[k + 2], 0.0) - list_dot_product({a}, past) AS h FROM lm) WHERE k < 600),
ls AS (SELECT k, h, sum(h) OVER (ORDER BY k) AS u FROM lm), g AS (SELECT {float(up.sum() / down.sum()):.17g}::DOUBLE AS g),
lf AS (SELECT t.key, t.n, t.e, {once.format(x='x', end='0', first='CASE WHEN s.e = 0 THEN s.x END')} AS y FROM lx t JOIN lx s ON s.key = t.key AND s.e <= t.e JOIN ls ON ls.k = t.e - s.e, g GROUP BY t.key, t.n, t.e),
lb AS (SELECT t.key, t.n, t.e, {once.format(x='y', end=f't.n + {2 * n - 1}', first=f'CASE WHEN s.e = t.n + {2 * n - 1} THEN s.y END')} AS y FROM lf t JOIN lf s ON s.key = t.key AND s.e >= t.e JOIN ls ON ls.k = s.e - t.e, g GROUP BY t.key, t.n, t.e),
lp AS (SELECT lb.key, li.t, lb.y AS f FROM lb JOIN li ON lb.key = li.key AND lb.e = li.i + {n})"""


def basins(df):
    """The two basins of the nation field."""
    return df.withColumn("basin", F.when(F.col("lat") <= 18, "south").otherwise("north"))


@query("i2_bandpass", "cell t", "f", views="f", ctes=PHASES, sql="SELECT cell, t, y AS f FROM bp", places=4)
def _(spark, d):
    return spectral.bandpass(detrended(spark, d), ["cell"], LONGEST, SHORTEST)


@query("i3_lowpass", "t", "f", "model", views="s", ctes="lo AS (SELECT model AS key, t, v AS x FROM s), " + zero_phase_sql("lo", kernels.butterworth(4, None, 2 / 12)), sql="SELECT key AS model, t, f FROM lp", places=4)
def _(spark, d):
    return spectral.lowpass(segment_month(spark, d), ["model"], 12)


@query("i6_analytic_phase", "cell t", "amplitude phase", views="f", ctes=PHASES, sql="SELECT cell, t, amplitude, phase FROM ph", places=4)
def _(spark, d):
    return phases(spark, d)


#: One scale of the wavelet at w0 = 6 for a period of twelve months, and the months at both ends that its cone covers.
_W0 = 6.0
_SCALE = 12 * (_W0 + math.sqrt(2 + _W0 * _W0)) / (4 * math.pi)
_CONE = math.ceil(math.sqrt(2) * _SCALE)


@query(
    "i7_wavelet_phase", "cell t", "phase", views="f", places=4,
    ctes=PHASES + f""", wn AS (SELECT b - a + 1 AS n FROM rg), wq AS (SELECT n, q, pow(pi(), -0.25) * exp(-0.5 * pow({_SCALE:.17g} * 2 * pi() * q / n - {_W0}, 2)) AS psi FROM (SELECT n, unnest(range(1, (n - 1) // 2 + 1)) AS q FROM wn)),
wk AS (SELECT d, sum(psi * cos(2 * pi() * q * d / n)) AS re, sum(psi * sin(2 * pi() * q * d / n)) AS im FROM (SELECT unnest(range(1 - n, n)) AS d FROM wn), wq GROUP BY d),
wm AS (SELECT cell, t, d - avg(d) OVER (PARTITION BY cell) AS d FROM dt),
wv AS (SELECT x.cell, x.t, sum(y.d * re) AS re, sum(y.d * im) AS im FROM wm x JOIN wm y ON x.cell = y.cell JOIN wk ON wk.d = x.t - y.t GROUP BY x.cell, x.t)""",
    sql=f"SELECT cell, t, CASE WHEN t - a >= {_CONE} AND b - t >= {_CONE} THEN atan2(im, re) END AS phase FROM wv, rg",
)
def _(spark, d):
    return spectral.wavelet_phase(detrended(spark, d), ["cell"], 12)


@query(
    "i9_spectrum", "", "frequency power", "model", views="s",
    ctes="""sk AS (SELECT model, v, row_number() OVER (PARTITION BY model ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY model) AS n FROM s),
sg AS (SELECT model, k - j AS start, j, v FROM sk, (SELECT unnest(range(0, 16)) AS j) WHERE (k - j) % 8 = 0 AND k - j >= 0 AND k - j + 16 <= n),
sd AS (SELECT model, start, j, (v - avg(v) OVER w - covar_pop(v, j) OVER w / var_pop(j) OVER w * (j - avg(j) OVER w)) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS y FROM sg WINDOW w AS (PARTITION BY model, start)),
sf AS (SELECT model, start, q, pow(sum(y * cos(2 * pi() * q * j / 16)), 2) + pow(sum(y * sin(2 * pi() * q * j / 16)), 2) AS p FROM sd, (SELECT unnest(range(0, 9)) AS q) GROUP BY ALL),
sp AS (SELECT model, q, avg(p) * CASE WHEN q BETWEEN 1 AND 7 THEN 2 ELSE 1 END AS p FROM sf GROUP BY model, q),
sa AS (SELECT model, sum(CASE WHEN q IN (0, 8) THEN p / 2 ELSE p END) / 16 AS area FROM sp GROUP BY model)""",
    sql="SELECT sp.model, q / 16.0 AS frequency, p / area AS power FROM sp JOIN sa ON sp.model = sa.model",
)
def _(spark, d):
    return spectral.spectrum(segment_month(spark, d), ["model"])


@query("i10_surrogate_envelope", "t", "q r")
def _(spark, d):
    return spectral.surrogate_envelope(spark, detrended(spark, d), 50, [0.05, 0.5, 0.95], LONGEST, SHORTEST)


@query("i13_transfer_entropy", "", "forward backward", "model")
def _(spark, d):
    s = segment_month(spark, d).join(ship_month(spark, d).select("t", "x"), "t")
    return spectral.transfer(s.select("model", "t", F.col("x").alias("source"), F.col("v").alias("target")), ["model"])


def coherence_by_year(spark, d):
    return radius.local_coherence(phases(spark, d), mean_field(spark, d), KM).withColumn("year", F.floor(F.col("t") / 12) + 1995)


AREA = f"{16 * (EARTH_KM * math.pi / 180) ** 2:.17g}"


def areas(spark, d):
    return mean_field(spark, d).select(*PLACE, cell_area_km2(F.col("lat"), 4.0, 4.0).alias("area"))


@query(
    "j6_largest_patch", "year", "area", views="f",
    ctes=LOCAL + f""", hi AS (SELECT lr.cell, CAST(floor(t / 12) AS BIGINT) + 1995 AS year, avg(r) AS r FROM lr GROUP BY ALL HAVING avg(r) > 0.5), pc AS (SELECT DISTINCT cell, lat_idx, lon_idx, lat FROM f), hp AS (SELECT hi.cell, year, lat_idx, lon_idx, cos(radians(lat)) * {AREA} AS area FROM hi JOIN pc ON hi.cell = pc.cell),
eg AS (SELECT a.year, a.cell, b.cell AS other FROM hp a JOIN hp b ON a.year = b.year AND abs(a.lat_idx - b.lat_idx) + abs(a.lon_idx - b.lon_idx) = 1),
rc AS (SELECT year, cell, cell AS other FROM hp UNION SELECT rc.year, rc.cell, eg.other FROM rc JOIN eg ON rc.year = eg.year AND rc.other = eg.cell),
ar AS (SELECT rc.year, rc.cell, sum(area) AS area FROM rc JOIN hp ON rc.year = hp.year AND rc.other = hp.cell GROUP BY ALL)""",
    sql="SELECT year, max(area) AS area FROM ar GROUP BY year", places=3,
)
def _(spark, d):
    high = coherence_by_year(spark, d).groupBy("cell", "year").agg(F.avg("r").alias("r")).where("r > 0.5")
    return spectral.largest_patches(high.join(areas(spark, d), "cell"), ["year"])


def blocked(spark, d):
    """basin, cell, block, x (mean local coherence), y (gradient)."""
    r = radius.local_coherence(phases(spark, d), mean_field(spark, d), KM).groupBy("cell").agg(F.avg("r").alias("x"))
    g = basins(grid.gradient(mean_field(spark, d)))
    b = spectral.spatial_blocks(g, ["basin"], 900.0)
    return g.select("basin", "cell", F.col("grad").alias("y")).join(r, "cell", "left").join(b, ["basin", "cell"])


#: The scan of greedy blocks: places in order, each a seed if no seed before it is within the radius, else with the nearest of those before it.
BLOCKS = f"""pl AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY cell) AS i FROM (SELECT cell, lat, lon, CASE WHEN lat <= 18 THEN 'south' ELSE 'north' END AS basin FROM m)),
er AS (SELECT a.basin, a.i, b.i AS j, {AB} AS km FROM pl a JOIN pl b ON a.basin = b.basin AND b.i < a.i WHERE {AB} <= 450),
nr AS (SELECT pl.basin, pl.i, list(er.j) FILTER (er.j IS NOT NULL) AS near FROM pl LEFT JOIN er ON pl.basin = er.basin AND pl.i = er.i GROUP BY ALL),
sd AS (SELECT DISTINCT basin, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS seeds FROM pl
 UNION ALL SELECT sd.basin, nr.i, CASE WHEN len(list_intersect(seeds, coalesce(near, []))) = 0 THEN list_append(seeds, nr.i) ELSE seeds END FROM sd JOIN nr ON sd.basin = nr.basin AND nr.i = sd.i + 1),
la AS (SELECT basin, seeds FROM sd WHERE i = (SELECT max(i) FROM pl WHERE pl.basin = sd.basin)),
op AS (SELECT er.basin, er.i, list_position(seeds, er.j) - 1 AS block, km FROM er JOIN la ON er.basin = la.basin WHERE list_contains(seeds, er.j) AND NOT list_contains(seeds, er.i)
 UNION ALL SELECT pl.basin, pl.i, list_position(seeds, pl.i) - 1, 0 FROM pl JOIN la ON pl.basin = la.basin WHERE list_contains(seeds, pl.i)),
bk AS (SELECT basin, cell, block FROM (SELECT op.*, cell, row_number() OVER (PARTITION BY op.basin, op.i ORDER BY km, block) AS place FROM op JOIN pl ON op.basin = pl.basin AND op.i = pl.i) WHERE place = 1)"""


@query("k3_spatial_blocks", "cell block", "", "basin", views="f", ctes=MEAN + ", " + BLOCKS, sql="SELECT basin, cell, block FROM bk")
def _(spark, d):
    return spectral.spatial_blocks(basins(mean_field(spark, d)), ["basin"], 900.0)


_U = [f"(CAST('0x' || substr(h, {6 * i + 1}, 6) AS BIGINT) + 0.5) / 16777216.0" for i in range(5)]
WAVES = f"""wv AS (SELECT number, wave, md5('1:' || number || ':' || wave) AS h FROM (SELECT unnest(range(0, 4)) AS number), (SELECT unnest(range(0, {spectral.WAVES})) AS wave)),
kv AS (SELECT number, sqrt(-2 * ln({_U[0]})) * cos(2 * pi() * {_U[1]}) / 600 AS kx, sqrt(-2 * ln({_U[0]})) * sin(2 * pi() * {_U[1]}) / 600 AS ky, sqrt(-2 * ln({_U[2]})) * cos(2 * pi() * {_U[3]}) / 600 AS kz, 2 * pi() * {_U[4]} AS p FROM wv),
sm AS (SELECT number, cell, sum(cos({EARTH_KM} * (kx * cos(radians(lat)) * cos(radians(lon)) + ky * cos(radians(lat)) * sin(radians(lon)) + kz * sin(radians(lat))) + p)) AS v FROM m, kv GROUP BY ALL)"""


@query("k8_gaussian_fields", "number cell", "v", views="f", ctes=MEAN + ", " + WAVES, sql="SELECT number, cell, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM sm WINDOW w AS (PARTITION BY number)")
def _(spark, d):
    return spectral.gaussian_fields(spark, mean_field(spark, d).select("cell", "lat", "lon"), 4, 600.0)


MEAN_R = LOCAL + ", " + GRAD + ", mr AS (SELECT cell, avg(r) AS r FROM lr GROUP BY cell)"
@query(
    "l1_block_permutation", "n_cells n_blocks", "rho p", "basin", views="f",
    ctes=MEAN_R + ", " + BLOCKS + f""", cb AS (SELECT bk.basin, block, r AS x, sqrt(gx * gx + gy * gy) AS y FROM bk JOIN gd ON bk.cell = gd.cell JOIN mr ON bk.cell = mr.cell WHERE r IS NOT NULL AND gx IS NOT NULL AND gy IS NOT NULL),
bm AS (SELECT basin, block, avg(x) AS x, avg(y) AS y FROM cb GROUP BY ALL), bi AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY block) - 1 AS i FROM bm),
rp AS (SELECT basin, r, x, row_number() OVER (PARTITION BY basin, r ORDER BY {DRAW.format(r='r', k='i', n='2147483647')}, i) - 1 AS place FROM bi, (SELECT unnest(range(0, 200)) AS r)),
nu AS (SELECT rp.basin, r, CASE WHEN var_pop(rp.x) > 0 AND var_pop(bi.y) > 0 THEN corr(rp.x, bi.y) END AS c FROM rp JOIN bi ON rp.basin = bi.basin AND rp.place = bi.i GROUP BY ALL),
hd AS (SELECT basin, count(*) AS n_cells, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS rho FROM cb GROUP BY basin), se AS (SELECT basin, count(*) AS n_blocks, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS seen FROM bm GROUP BY basin),
pv AS (SELECT nu.basin, greatest(avg(CASE WHEN abs(c) >= abs(seen) - 1e-12 THEN 1.0 WHEN c IS NOT NULL THEN 0.0 END), 1 / 200.0) AS p FROM nu JOIN se ON nu.basin = se.basin GROUP BY nu.basin)""",
    sql="SELECT hd.basin, n_cells, n_blocks, CASE WHEN n_cells >= 10 AND n_blocks >= 4 THEN rho END AS rho, CASE WHEN n_cells >= 10 AND n_blocks >= 4 THEN p END AS p FROM hd JOIN se ON hd.basin = se.basin LEFT JOIN pv ON hd.basin = pv.basin", places=4,
)
def _(spark, d):
    return stats.block_permutation(blocked(spark, d), 200, ["basin"])


CELLS = MEAN_R + ", ce AS (SELECT CASE WHEN lat <= 18 THEN 'south' ELSE 'north' END AS basin, CAST(floor(lat / 8) * 100 + floor(lon / 8) AS BIGINT) AS block, r AS x, sqrt(gx * gx + gy * gy) AS y FROM mr JOIN gd USING (cell) WHERE r IS NOT NULL AND gx IS NOT NULL AND gy IS NOT NULL)"
Z = "greatest(-0.999999, least(0.999999, {}))"


@query(
    "l2_block_interval", "n_cells n", "rho_cells rho low high boot_low boot_high", "basin", views="f", places=4,
    ctes=CELLS + f""", bm AS (SELECT basin, block, avg(x) AS x, avg(y) AS y FROM ce GROUP BY ALL), bi AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY basin) AS n FROM bm),
hd AS (SELECT basin, count(*) AS n_cells, corr(x, y) AS rho_cells FROM ce GROUP BY basin), wh AS (SELECT basin, count(*) AS n, corr(x, y) AS rho FROM bm GROUP BY basin),
rp AS (SELECT basin, r, {DRAW.format(r='r', k='k', n='n')} AS i FROM (SELECT basin, max(n) AS n FROM bi GROUP BY basin), (SELECT unnest(range(0, 200)) AS r), (SELECT unnest(range(0, 100)) AS k) WHERE k < n),
rc AS (SELECT rp.basin, r, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS c FROM rp JOIN bi ON rp.basin = bi.basin AND rp.i = bi.i GROUP BY ALL),
bo AS (SELECT basin, tanh(quantile_cont(atanh({Z.format('c')}), 0.025)) AS boot_low, tanh(quantile_cont(atanh({Z.format('c')}), 0.975)) AS boot_high FROM rc WHERE c IS NOT NULL GROUP BY basin)""",
    sql=f"""SELECT hd.basin, n_cells, n, rho_cells, rho, CASE WHEN n_cells >= 10 THEN tanh(atanh({Z.format('rho')}) - 1.959963984540054 / sqrt(n - 3)) END AS low, CASE WHEN n_cells >= 10 THEN tanh(atanh({Z.format('rho')}) + 1.959963984540054 / sqrt(n - 3)) END AS high,
  CASE WHEN n_cells >= 10 THEN boot_low END AS boot_low, CASE WHEN n_cells >= 10 THEN boot_high END AS boot_high FROM hd JOIN wh ON hd.basin = wh.basin JOIN bo ON hd.basin = bo.basin WHERE n > 3""",
)
def _(spark, d):
    """Blocks of eight degrees in each basin."""
    r = radius.local_coherence(phases(spark, d), mean_field(spark, d), KM).groupBy("cell").agg(F.avg("r").alias("x"))
    block = (F.floor(F.col("lat") / 8) * 100 + F.floor(F.col("lon") / 8)).alias("block")
    g = basins(grid.gradient(mean_field(spark, d))).select("basin", "cell", block, F.col("grad").alias("y"))
    return stats.block_bootstrap(spark, r.join(g, "cell"), 200, ["basin"]).where("n > 3")


@query(
    "m6_block_p", "cell n", "slope p", views="f p",
    ctes=f"""xi AS (SELECT t, x, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM p), pl AS (SELECT cell, i AS place, f.v AS y, x FROM f JOIN xi ON f.t - 5 = xi.t),
rp AS (SELECT r, k * 12 + o AS place, ({DRAW.format(r='r', k='k', n='n')} + o) % n AS i FROM (SELECT max(n) AS n FROM xi), (SELECT unnest(range(0, 99)) AS r), (SELECT unnest(range(0, 50)) AS k), (SELECT unnest(range(0, 12)) AS o) WHERE k < ceil(n / 12) AND k * 12 + o < n),
xr AS (SELECT r, rp.place, xi.x FROM rp JOIN xi ON rp.i = xi.i), se AS (SELECT cell, count(*) AS n, regr_slope(y, x) AS slope FROM pl GROUP BY cell), nu AS (SELECT pl.cell, r, regr_slope(y, xr.x) AS b FROM pl JOIN xr ON pl.place = xr.place GROUP BY pl.cell, r)""",
    sql="SELECT cell, n, slope, (1 + count(*) FILTER (abs(b) >= abs(slope) - 1e-12)) / 100.0 AS p FROM nu JOIN se USING (cell) GROUP BY cell, n, slope",
)
def _(spark, d):
    rows = nation_month(spark, d).select("cell", (F.col("t") - 5).alias("t"), F.col("v").alias("y"))
    return stats.block_p(spark, rows, ["cell"], ship_month(spark, d).select("t", "x"), 99, 12)


@query("m7_closure_fits", "k", "ss chi2 aic bic", "basin family best")
def _(spark, d):
    cells = blocked(spark, d).select("basin", F.col("y").alias("d"), F.col("x").alias("r"))
    return spectral.closures(cells, ["basin"], kernels.CLOSURES | kernels.FAMILIES)


@query(
    "n1_correlation_test", "n", "rho p low high", "verdict", views="s", places=4,
    ctes="bo AS (SELECT a.t, a.v AS x, b.v AS y FROM s a JOIN s b ON a.t = b.t WHERE a.model = 'BUILDING' AND b.model = 'MACHINERY'), lo AS (SELECT 'x' AS key, t, x FROM bo UNION ALL SELECT 'y', t, y FROM bo), "
    + zero_phase_sql("lo", kernels.butterworth(4, None, 2 / 12))
    + f""", pr AS (SELECT x.t, x.f AS x, y.f AS y, row_number() OVER (ORDER BY x.t) - 1 AS i, count(*) OVER () AS n FROM lp x JOIN lp y ON x.t = y.t WHERE x.key = 'x' AND y.key = 'y'),
co AS (SELECT count(*) AS n, corr(x, y) AS rho FROM pr),
rp AS (SELECT r, k * 12 + o AS place, ({DRAW.format(r='r', k='k', n='n')} + o) % n AS i FROM (SELECT max(n) AS n FROM pr), (SELECT unnest(range(0, 200)) AS r), (SELECT unnest(range(0, 50)) AS k), (SELECT unnest(range(0, 12)) AS o) WHERE k < ceil(n / 12) AND k * 12 + o < n),
rc AS (SELECT r, corr(x, y) AS c FROM rp JOIN pr ON rp.i = pr.i GROUP BY r), iv AS (SELECT quantile_cont(c, 0.025) AS low, quantile_cont(c, 0.975) AS high FROM rc),
pv AS (SELECT n, rho, n - 2 AS dof, asin(abs(rho)) AS angle FROM co), pw AS (SELECT n, rho, {t_p_sql('angle', 'dof')} AS p FROM pv)""",
    sql="SELECT n, rho, p, low, high, CASE WHEN n < 24 THEN 'deferred' WHEN rho < 0.3 THEN 'falsified' WHEN rho >= 0.6 AND p < 0.01 THEN 'supported' ELSE 'deferred' END AS verdict FROM pw, iv",
)
def _(spark, d):
    s = segment_month(spark, d)
    x, y = (s.where(F.col("model") == m).select("t", "v") for m in ("BUILDING", "MACHINERY"))
    return decide.correlation_test(spark, x, y)


@query(
    "n2_area_test", "years passing", "share", "verdict", views="f",
    ctes=LOCAL + f""", yr AS (SELECT lr.cell, CAST(floor(t / 12) AS BIGINT) + 1995 AS year, avg(r) AS r FROM lr GROUP BY ALL), pc AS (SELECT DISTINCT cell, lat_idx, lon_idx, lat FROM f),
hp AS (SELECT CASE WHEN lat <= 18 THEN 'low' ELSE 'high' END AS box, yr.cell, year, lat_idx, lon_idx, cos(radians(lat)) * {AREA} AS area FROM yr JOIN pc ON yr.cell = pc.cell WHERE lat <= 18 AND r <= 0.5 OR lat > 18 AND r >= 0.8),
eg AS (SELECT a.box, a.year, a.cell, b.cell AS other FROM hp a JOIN hp b ON a.box = b.box AND a.year = b.year AND abs(a.lat_idx - b.lat_idx) + abs(a.lon_idx - b.lon_idx) = 1),
rc AS (SELECT box, year, cell, cell AS other FROM hp UNION SELECT rc.box, rc.year, rc.cell, eg.other FROM rc JOIN eg ON rc.box = eg.box AND rc.year = eg.year AND rc.other = eg.cell),
ar AS (SELECT rc.box, rc.year, rc.cell, sum(area) AS area FROM rc JOIN hp ON rc.box = hp.box AND rc.year = hp.year AND rc.other = hp.cell GROUP BY ALL),
mx AS (SELECT year, max(CASE WHEN box = 'low' THEN area END) AS a, max(CASE WHEN box = 'high' THEN area END) AS b FROM ar GROUP BY year),
yy AS (SELECT DISTINCT year FROM yr), ct AS (SELECT count(*) AS years, count(*) FILTER (coalesce(a, 0) >= 1e6 AND coalesce(b, 0) >= 5e5) AS passing FROM yy LEFT JOIN mx ON yy.year = mx.year)""",
    sql="SELECT years, passing, passing / nullif(years, 0) AS share, CASE WHEN passing / nullif(years, 0) >= 0.5 THEN 'supported' ELSE 'falsified' END AS verdict FROM ct",
)
def _(spark, d):
    return decide.area_test(coherence_by_year(spark, d).drop("t"), areas(spark, d), F.col("lat") <= 18, F.col("lat") > 18, least_high=5e5)


@query(
    "n3_lead_time_test", "warning event lead", "", "model verdict", views="e",
    ctes="""nl AS (SELECT *, lag(v) OVER w AS q, row_number() OVER w AS k, count(*) OVER (PARTITION BY model) AS n FROM e WINDOW w AS (PARTITION BY model ORDER BY t)),
nr AS (SELECT *, CASE WHEN k >= 48 THEN var_samp(v) OVER (PARTITION BY model ORDER BY t ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) END AS va, CASE WHEN k >= 48 THEN corr(v, q) OVER (PARTITION BY model ORDER BY t ROWS BETWEEN 46 PRECEDING AND CURRENT ROW) END AS ac FROM nl),
nv AS (SELECT *, avg(va) OVER m + stddev_pop(va) OVER m AS hv, avg(ac) OVER m + stddev_pop(ac) OVER m AS ha, avg(v) OVER m - 0.5 * stddev_pop(v) OVER m AS lv FROM nr WINDOW m AS (PARTITION BY model)),
nc AS (SELECT *, min(CASE WHEN va > hv THEN 1 ELSE 0 END) OVER a AS ra, min(CASE WHEN ac > ha THEN 1 ELSE 0 END) OVER a AS rb, min(CASE WHEN v < lv THEN 1 ELSE 0 END) OVER b AS rv FROM nv
 WINDOW a AS (PARTITION BY model ORDER BY t ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), b AS (PARTITION BY model ORDER BY t ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
nf AS (SELECT model, min(CASE WHEN ra = 1 AND k + 6 <= n THEN t END) AS a, min(CASE WHEN rb = 1 AND k + 6 <= n THEN t END) AS b, min(CASE WHEN rv = 1 AND k + 2 <= n THEN t END) AS event FROM nc GROUP BY model),
nw AS (SELECT model, coalesce(least(a, b), a, b) AS warning, event FROM nf)""",
    sql="SELECT model, warning, event, event - warning AS lead, CASE WHEN event - warning >= 24 THEN 'supported' WHEN event - warning < 24 THEN 'falsified' ELSE 'deferred' END AS verdict FROM nw",
)
def _(spark, d):
    e = events_hour(spark, d)
    return decide.lead_time_test(series.rolling(e, ["model"], 48), ["model"])


@query("n5_cross_prediction", "", "q p tau chi2", "basin verdict")
def _(spark, d):
    return decide.cross_prediction(spark, blocked(spark, d), ["basin"], 200)
