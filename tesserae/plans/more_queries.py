"""Queries on filters, calendars, special functions, fields made by rule and registered functions (2.B, 2.C, 2.G, 2.H, 2.K, 2.L, 2.M, 2.Q)."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import registered, scalar
from tesserae.operators import grid, series, stats
from tesserae.plans.grid_queries import mean_field
from tesserae.plans.regression_queries import t_p_sql
from tesserae.queries import query
from tesserae.sources.fields import customer_grid, nation_month, segment_month, ship_month, table


@query("b2_rotated_lon", "n", "low high", views="g", sql="SELECT count(*) AS n, min(r) AS low, max(r) AS high FROM (SELECT (lon + 170) - 360 * floor((lon + 170) / 360) AS r FROM g)")
def _(spark, d):
    return customer_grid(spark, d).select(scalar.rotated_lon(F.col("lon"), -170.0).alias("r")).agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))


@query("b4_named_regions", "n", "v", "region", views="f", ctes="r AS (SELECT *, CASE WHEN lat >= 22 AND lon <= -52 THEN 'gyre' WHEN lat BETWEEN 14 AND 18 THEN 'pathway' END AS region FROM f)", sql="SELECT region, count(*) AS n, avg(v) AS v FROM r WHERE region IS NOT NULL GROUP BY region")
def _(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    region = F.when((lat >= 22) & (lon <= -52), "gyre").when(lat.between(14, 18), "pathway")
    return nation_month(spark, d).withColumn("region", region).where("region IS NOT NULL").groupBy("region").agg(F.count("*").alias("n"), F.avg("v").alias("v"))


@query("b5_box_on_axes", "n", "v", "box", views="g", sql="SELECT * FROM (SELECT 'plain' AS box, count(*) AS n, avg(v) AS v FROM g WHERE lat BETWEEN 10 AND 40 AND lon BETWEEN -35 AND -20 UNION ALL SELECT 'turned', count(*), avg(v) FROM g WHERE lat BETWEEN 10 AND 40 AND lon BETWEEN -35 AND -20 UNION ALL SELECT 'across', count(*), avg(v) FROM g WHERE lat BETWEEN 0 AND 60 AND (lon * 9 - 360 * floor(lon * 9 / 360) >= 350 OR lon * 9 - 360 * floor(lon * 9 / 360) <= 20)) WHERE n > 0")
def _(spark, d):
    """The same box on axes of either direction and either range of longitudes, and one across the seam."""
    g = customer_grid(spark, d)
    lat, lon = F.col("lat"), F.col("lon")
    boxes = {"plain": scalar.box_on_axes(lat, lon, 10.0, 40.0, -35.0, -20.0), "turned": scalar.box_on_axes(lat, F.pmod(lon, F.lit(360.0)), 40.0, 10.0, 325.0, 340.0), "across": scalar.box_on_axes(lat, lon * 9, 0.0, 60.0, 350.0, 20.0)}
    box = F.explode(F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in boxes.items()]), lambda x: x.isNotNull())).alias("box")
    return g.select(box, "v").groupBy("box").agg(F.count("*").alias("n"), F.avg("v").alias("v"))


_CAL = "dy AS (SELECT date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS n, o_totalprice AS v FROM orders), ml AS (SELECT [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334] AS ms), c AS (SELECT '360_day' AS calendar, 1995 + n // 360 AS year, (n % 360) // 30 + 1 AS month, v FROM dy UNION ALL SELECT 'noleap', 1995 + n // 365, len(list_filter(ms, lambda x: x <= n % 365)), v FROM dy, ml UNION ALL SELECT 'standard', year(DATE '1995-01-01' + CAST(n AS INT)), month(DATE '1995-01-01' + CAST(n AS INT)), v FROM dy)"


@query("b6_calendar_slice", "year month n", "v", "calendar", ctes=_CAL, sql="SELECT calendar, year, month, count(*) AS n, avg(v) AS v FROM c WHERE year BETWEEN 1996 AND 1999 GROUP BY ALL")
def _(spark, d):
    """Days counted from one day on, read in three calendars, two of which no date type holds; years inclusive at both ends."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    o = table(spark, d, "orders").select(day.alias("days"), F.col("o_totalprice").alias("v"))
    parts = []
    for name in ("360_day", "noleap", "standard"):
        year, month, _day = scalar.calendar_day(name, F.col("days"), 1995)
        parts.append(o.select(F.lit(name).alias("calendar"), year.alias("year"), month.alias("month"), "v"))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.where(F.col("year").between(1996, 1999)).groupBy("calendar", "year", "month").agg(F.count("*").alias("n"), F.avg("v").alias("v"))


@query("b7_sentinel_mask", "n kept", "v", sql="SELECT count(*) AS n, count(*) FILTER (c_acctbal > 0) AS kept, avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS v FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select(scalar.masked(F.col("c_acctbal"), 0.0).alias("v")).agg(F.count("*").alias("n"), F.count("v").alias("kept"), F.avg("v").alias("v"))


@query("b10_nearest_level", "", "level", "brand", sql="SELECT p_brand AS brand, arg_min(p_size * 20.0, abs(p_size * 20.0 - 850) * 1000 + p_size) AS level FROM part GROUP BY 1 HAVING min(abs(p_size * 20.0 - 850)) <= 42.5")
def _(spark, d):
    level = F.col("p_size") * 20.0
    gap = F.abs(level - 850)
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min_by(level, F.struct(gap, "p_size")).alias("level"), F.min(gap).alias("gap")).where("gap <= 42.5")


@query("b12_b13_units", "key", "hpa mm watts", sql="SELECT o_orderkey AS key, o_totalprice / 100 AS hpa, o_totalprice / 86400 AS watts, o_totalprice * 86400 / 1e6 AS mm FROM orders", places=9)
def _(spark, d):
    v = F.col("o_totalprice")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (v / 100).alias("hpa"), (v / 86400).alias("watts"), (v * 86400 / 1e6).alias("mm"))


@query("c2_three_way_years", "year", "a b c", views="s p", ctes="y1 AS (SELECT year, avg(v) AS a FROM s WHERE model = 'BUILDING' GROUP BY year), y2 AS (SELECT year, avg(v) AS b FROM s WHERE model = 'MACHINERY' GROUP BY year), y3 AS (SELECT year, avg(y) AS c FROM p GROUP BY year)", sql="SELECT year, a, b, c FROM y1 JOIN y2 USING (year) JOIN y3 USING (year)")
def _(spark, d):
    s = segment_month(spark, d)
    y1, y2 = (series.annual(s.where(F.col("model") == m), []).withColumnRenamed("v", n) for m, n in (("BUILDING", "a"), ("MACHINERY", "b")))
    y3 = ship_month(spark, d).groupBy("year").agg(F.avg("y").alias("c"))
    return y1.join(y2, "year").join(y3, "year")


@query("c11_climatology_join", "cell t", "a", views="f", ctes="c AS (SELECT cell, month, avg(v) AS m FROM f GROUP BY ALL)", sql="SELECT f.cell, t, v - m AS a FROM f JOIN c ON f.cell = c.cell AND f.month = c.month", places=10)
def _(spark, d):
    f = nation_month(spark, d)
    return f.join(f.groupBy("cell", "month").agg(F.avg("v").alias("m")), ["cell", "month"]).withColumn("a", F.col("v") - F.col("m"))


@query("c13_aligned_stack", "lat_idx lon_idx n", "v", views="f", ctes="a AS (SELECT lat_idx, lon_idx, avg(v) AS v FROM f WHERE year = 1996 GROUP BY ALL), b AS (SELECT lat_idx, lon_idx, avg(v) AS v FROM f WHERE year = 1999 AND month = 6 GROUP BY ALL HAVING avg(v) > 0.9)", sql="SELECT a.lat_idx, a.lon_idx, 1 + CASE WHEN b.v IS NULL THEN 0 ELSE 1 END AS n, (a.v + coalesce(b.v, 0)) / (1 + CASE WHEN b.v IS NULL THEN 0 ELSE 1 END) AS v FROM a LEFT JOIN b ON a.lat_idx = b.lat_idx AND a.lon_idx = b.lon_idx")
def _(spark, d):
    f = nation_month(spark, d)
    a = f.where("year = 1996").groupBy("lat_idx", "lon_idx").agg(F.avg("v").alias("a"))
    b = f.where("year = 1999 AND month = 6").groupBy("lat_idx", "lon_idx").agg(F.avg("v").alias("b")).where("b > 0.9")  # a model with holes
    n = 1 + F.col("b").isNotNull().cast("int")
    return a.join(b, ["lat_idx", "lon_idx"], "left").select("lat_idx", "lon_idx", n.alias("n"), ((F.col("a") + F.coalesce("b", F.lit(0.0))) / n).alias("v"))


@query("e5_sliding_lagged_slope", "t n", "slope", views="p", ctes="l AS (SELECT t, y, lag(x, 5) OVER (ORDER BY t) AS q FROM p)", sql="SELECT t, count(q) OVER w AS n, CASE WHEN count(q) OVER w >= 18 THEN covar_pop(y, q) OVER w / var_pop(CASE WHEN y IS NOT NULL THEN q END) OVER w END AS slope FROM l WINDOW w AS (ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)", places=4)
def _(spark, d):
    o = Window.partitionBy(F.lit(1)).orderBy("t")  # one series of months
    rows = ship_month(spark, d).withColumn("q", F.lag("x", 5).over(o))
    w = o.rowsBetween(-29, 0)
    n = F.count("q").over(w)
    return rows.select("t", n.alias("n"), F.when(n >= 18, F.covar_pop("y", "q").over(w) / F.var_pop("q").over(w)).alias("slope"))


@query("g3_l15_label_permutations", "chosen as_extreme", "share", views="s", ctes="m AS (SELECT row_number() OVER (ORDER BY model) - 1 AS i, avg(v) AS v FROM s GROUP BY model), k AS (SELECT mask, sum(CASE WHEN (mask // CAST(pow(2, i) AS INT)) % 2 = 1 THEN v END) AS a, count(*) FILTER ((mask // CAST(pow(2, i) AS INT)) % 2 = 1) AS n FROM (SELECT unnest(range(0, 32)) AS mask), m GROUP BY mask), c AS (SELECT round(a, 9) AS a, round((SELECT sum(v) FROM m WHERE i < 2), 9) AS o FROM k WHERE n = 2)", sql="SELECT count(*) AS chosen, count(*) FILTER (a >= o) AS as_extreme, avg(CASE WHEN a >= o THEN 1.0 ELSE 0.0 END) AS share FROM c")
def _(spark, d):
    means = segment_month(spark, d).groupBy("model").agg(F.avg("v").alias("v"))
    return stats.label_permutations(spark, means, "model", 2)


@query("h2_string_tests", "n", "", "kind", sql="SELECT CASE WHEN starts_with(lower(p_name), 'red') THEN 'red' WHEN contains(p_name, 'ring') THEN 'ring' WHEN ends_with(p_type, 'Y') THEN 'y' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    kind = F.when(F.lower("p_name").startswith("red"), "red").when(F.col("p_name").contains("ring"), "ring").when(F.col("p_type").endswith("Y"), "y").otherwise("other")
    return table(spark, d, "part").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("h4_age_to_year", "t", "year", views="p", sql="SELECT t, 1950 - 1000 * (t / 100.0) AS year FROM p")
def _(spark, d):
    return ship_month(spark, d).select("t", scalar.age_to_year(F.col("t") / 100.0).alias("year"))


@query("h9_closures", "t", "simple weak exponential", views="p", sql="SELECT t, 1 / sqrt(1 + 50 * z) AS simple, 0.05 / (2 * z) AS weak, exp(-50 * z) AS exponential FROM p")
def _(spark, d):
    z = F.col("z")
    return ship_month(spark, d).select("t", scalar.closure_simple(z, 50).alias("simple"), scalar.closure_weak(z, 0.05).alias("weak"), scalar.closure_exp(z, 50).alias("exponential"))


_BES = "k AS (SELECT unnest(range(0, 60)) AS k), lf AS (SELECT k, lgamma(k + 1.0) AS f0, lgamma(k + 2.0) AS f1 FROM k), be AS (SELECT t, z, sum(exp((2 * k + 1) * ln(20 * z / 2) - f0 - f1)) / sum(exp(2 * k * ln(20 * z / 2) - 2 * f0)) AS b, 2 / sqrt(pi()) * sum((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(z) - f0) / (2 * k + 1)) AS e FROM p, lf GROUP BY t, z)"


@query("h9_q3_registered_functions", "t", "e b", views="p", ctes=_BES, sql="SELECT t, e, b FROM be")
def _(spark, d):
    """The error function and the Bessel ratio, in SQL by their registered names; DuckDB sums their series."""
    registered.register(spark)
    return ship_month(spark, d).selectExpr("t", "erf(z) AS e", "bessel_ratio(20 * z) AS b")


@query("h9_correlation_p", "t", "p", views="p", ctes="ra AS (SELECT t, asin(z * 5) AS angle, 58 AS dof FROM p)", sql=f"SELECT t, {t_p_sql('angle', 'dof')} AS p FROM ra")
def _(spark, d):
    """The tangent of a correlation's angle is t over the root of the degrees of freedom."""
    registered.register(spark)
    return ship_month(spark, d).selectExpr("t", "pearson_p(z * 5, 60) AS p")


@query("m8_exit_fraction", "n outside", "level", views="p", ctes="k AS (SELECT a.t, avg(exp(-0.5 * (pow((a.x - b.x) / (0.3 * sx), 2) + pow((a.y - b.y) / (0.3 * sy), 2)))) AS d FROM p a, p b, (SELECT stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM p) GROUP BY a.t)", sql="SELECT count(*) AS n, count(*) FILTER (d < q) AS outside, q AS level FROM k, (SELECT quantile_cont(d, 0.1) AS q FROM k) GROUP BY q")
def _(spark, d):
    return stats.exit_fraction(ship_month(spark, d), 0.3, 0.1)


@query("c7_k6_coarse_sample", "cell", "v", views="f g", ctes="m AS (SELECT lat_idx, lon_idx, avg(v) AS v FROM f GROUP BY ALL)", sql="SELECT g.cell, m.v FROM g JOIN m ON m.lat_idx = least(4, greatest(0, floor((g.lat - 10) / 4 + 0.5))) AND m.lon_idx = least(4, greatest(0, floor((g.lon + 60) / 4 + 0.5)))")
def _(spark, d):
    nearest = lambda x, start: F.least(F.lit(4), F.greatest(F.lit(0), F.floor((x - start) / 4 + 0.5))).cast("int")
    g = customer_grid(spark, d).select("cell", nearest(F.col("lat"), 10.0).alias("lat_idx"), nearest(F.col("lon"), -60.0).alias("lon_idx"))
    return g.join(mean_field(spark, d).select("lat_idx", "lon_idx", "v"), ["lat_idx", "lon_idx"])
