"""Queries on series (2.D, 2.E, 2.F, 2.G, 2.H, 2.I)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import scalar
from tesserae.operators import series
from tesserae.queries import query
from tesserae.sources.fields import events_hour, exact_sum, nation_month, segment_month, ship_month, table

CORR = "CASE WHEN var_pop({x}) {w} > 0 AND var_pop({y}) {w} > 0 THEN covar_pop({x}, {y}) {w} / sqrt(var_pop({x}) {w} * var_pop({y}) {w}) END"


@query("d3_anomaly", "cell t", "a", views="f", sql="SELECT cell, t, v - avg(v) OVER (PARTITION BY cell, month) AS a FROM f", places=10)
def _(spark, d):
    return series.anomaly(nation_month(spark, d), ["cell"])


@query("d4_annual_mean", "cell year", "v", views="f", sql="SELECT cell, year, avg(v) AS v FROM f GROUP BY ALL")
def _(spark, d):
    return series.annual(nation_month(spark, d), ["cell"])


@query("d5_winter_by_january", "season n", "v", "model", views="s", sql="SELECT model, year + CASE WHEN month = 12 THEN 1 ELSE 0 END AS season, count(v) AS n, avg(v) AS v FROM s WHERE month IN (12, 1, 2) GROUP BY ALL HAVING count(v) >= 3")
def _(spark, d):
    return series.winter(segment_month(spark, d), ["model"])


@query("d5_winter_by_december", "season n", "v", "model", views="s", sql="SELECT model, year - CASE WHEN month = 12 THEN 0 ELSE 1 END AS season, count(v) AS n, avg(v) AS v FROM s WHERE month IN (12, 1, 2) GROUP BY ALL")
def _(spark, d):
    return series.winter(segment_month(spark, d), ["model"], by_january=False)


@query("d6_summer_mean", "year", "v", "model", views="s", sql="SELECT model, year, avg(v) AS v FROM s WHERE month BETWEEN 6 AND 9 GROUP BY ALL")
def _(spark, d):
    return series.months_mean(segment_month(spark, d), ["model"], 6, 9)


@query("d9_base_anomaly", "t", "a", "model", views="s", sql="SELECT model, t, v - CASE WHEN count(*) FILTER (year = 1995) OVER w >= 2 THEN avg(v) FILTER (year = 1995) OVER w ELSE quantile_cont(v, 0.5) OVER w END AS a FROM s WINDOW w AS (PARTITION BY model)")
def _(spark, d):
    return series.base_anomaly(segment_month(spark, d), ["model"], F.col("year") == 1995)


@query("d19_two_pass_variance", "cell", "e", views="f", sql="SELECT cell, avg(a * a) / 2 AS e FROM (SELECT cell, v - avg(v) OVER (PARTITION BY cell) AS a FROM f) GROUP BY cell")
def _(spark, d):
    w = Window.partitionBy("cell")
    return nation_month(spark, d).withColumn("a", F.col("v") - F.avg("v").over(w)).groupBy("cell").agg((F.avg(F.col("a") * F.col("a")) / 2).alias("e"))


@query("d25_paleo_stack", "place n", "v", views="f", ctes="one AS (SELECT cell, t * 7 + (t * t + cell * 3) % 5 AS age, v FROM f), pr AS (SELECT *, lead(age) OVER w AS na, lead(v) OVER w AS nv FROM one WINDOW w AS (PARTITION BY cell ORDER BY age)), gr AS (SELECT unnest(range(0, 601, 10)) AS place), ip AS (SELECT DISTINCT cell, place, v + (nv - v) * (place - age) / (na - age) AS v FROM pr JOIN gr ON place >= age AND place <= na WHERE na IS NOT NULL), iq AS (SELECT cell, place, max(v) AS v FROM ip GROUP BY ALL)", sql="SELECT place, count(*) AS n, avg(v) AS v FROM iq GROUP BY place HAVING count(*) >= 3", places=5)
def _(spark, d):
    age = F.col("t") * 7 + (F.col("t") * F.col("t") + F.col("cell") * 3) % 5  # irregular ages of all samples
    return series.stack(nation_month(spark, d).select("cell", age.alias("age"), "v"), ["cell"], 10, 0, 600).withColumnRenamed("at", "place")


@query("e1_sliding_windows", "start centre n", "mean", "model", views="s", ctes="ws AS (SELECT unnest(range(1995, 2000)) AS start)", sql="SELECT model, start, start + 1 AS centre, count(v) AS n, CASE WHEN count(v) >= 0.8 * 36 THEN avg(v) END AS mean FROM s JOIN ws ON year BETWEEN start AND start + 2 GROUP BY ALL")
def _(spark, d):
    return series.windows(segment_month(spark, d), ["model"], 3, 1, 1995, 2001)


@query("e2_e3_rolling", "t", "var ac1", "model", views="s", ctes="l AS (SELECT *, lag(v) OVER (PARTITION BY model ORDER BY t) AS q, row_number() OVER (PARTITION BY model ORDER BY t) AS k FROM s)", sql="SELECT model, t, CASE WHEN k >= 24 THEN var_samp(v) OVER (PARTITION BY model ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS var, CASE WHEN k >= 24 THEN corr(v, q) OVER (PARTITION BY model ORDER BY t ROWS BETWEEN 22 PRECEDING AND CURRENT ROW) END AS ac1 FROM l")
def _(spark, d):
    return series.rolling(segment_month(spark, d), ["model"], 24)


@query("e6_lag_correlation", "lag n", "r", views="p", ctes="lg AS (SELECT unnest([-6, -3, -1, 0, 1, 3, 6]) AS lag)", sql="SELECT lag, count(*) AS n, corr(a.x, b.z) AS r FROM p a JOIN lg ON true JOIN p b ON b.t = a.t + lag GROUP BY lag HAVING count(*) >= 30")
def _(spark, d):
    rows = ship_month(spark, d).select(F.lit(0).alias("g"), "t", "x", F.col("z").alias("y"))
    return series.lag_correlation(rows, ["g"], [-6, -3, -1, 0, 1, 3, 6])


@query("e7_central_difference", "t", "dv", "model", views="s", sql="SELECT model, t, coalesce((lead(v) OVER w - lag(v) OVER w) / 2, lead(v) OVER w - v, v - lag(v) OVER w) AS dv FROM s WINDOW w AS (PARTITION BY model ORDER BY t)")
def _(spark, d):
    return series.central_difference(segment_month(spark, d), ["model"])


CROSS = "m AS (SELECT *, avg(v) OVER (PARTITION BY model) AS c, row_number() OVER (PARTITION BY model ORDER BY t) AS k, count(*) OVER (PARTITION BY model) AS n FROM e), r AS (SELECT *, min(CASE WHEN v > c THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS run FROM m)"


@query("e8_first_crossing", "first", "", "model", views="e", ctes=CROSS, sql="SELECT model, coalesce(min(CASE WHEN run = 1 AND k + 3 <= n THEN t END), -1) AS first FROM r GROUP BY model")
def _(spark, d):
    rows = events_hour(spark, d).withColumn("c", F.avg("v").over(Window.partitionBy("model")))
    return series.first_crossing(rows, ["model"], F.col("v") > F.col("c"), 3).withColumn("first", F.coalesce("first", F.lit(-1)))


@query("e9_strict_exit", "exit", "", "model", views="e", ctes="m AS (SELECT *, quantile_cont(v, 0.6) OVER (PARTITION BY model) AS c, stddev_pop(v) OVER (PARTITION BY model) AS sd FROM e), r AS (SELECT *, min(CASE WHEN v > c THEN 1 ELSE 0 END) OVER w AS run, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY model ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))", sql="SELECT model, coalesce(min(CASE WHEN v > c + 0.1 * sd AND run = 1 AND n = 3 THEN t END), -1) AS exit FROM r GROUP BY model")
def _(spark, d):
    w = Window.partitionBy("model")
    rows = events_hour(spark, d).withColumn("c", F.percentile("v", 0.6).over(w)).withColumn("sd", F.stddev_pop("v").over(w))
    return series.strict_exit(rows, ["model"], F.col("c"), 0.1 * F.col("sd")).withColumn("exit", F.coalesce("exit", F.lit(-1)))


@query("e10_overturning", "cell", "strength", views="f", ctes="st AS (SELECT cell, t, v, 0.5 * (v - 3 + lag(v - 3) OVER w) * (t - lag(t) OVER w) AS q FROM f WINDOW w AS (PARTITION BY cell ORDER BY t)), cs AS (SELECT cell, sum(coalesce(q, 0)) OVER (PARTITION BY cell ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM st)", sql="SELECT cell, max(c) AS strength FROM cs GROUP BY cell")
def _(spark, d):
    rows = nation_month(spark, d).select("cell", F.col("t").cast("double").alias("z"), (F.col("v") - 3).alias("v"))
    return series.overturning(rows, ["cell"])


@query("f1_priority_order", "rank", "v", "model", views="s", sql="SELECT model, row_number() OVER (ORDER BY CASE model WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, sum(v) DESC) AS rank, sum(v) AS v FROM s GROUP BY model")
def _(spark, d):
    sums = segment_month(spark, d).groupBy("model").agg(F.sum("v").alias("v"))  # a row a model
    priority = F.when(F.col("model") == "BUILDING", 0).when(F.col("model") == "MACHINERY", 1).otherwise(2)
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(priority, F.desc("v"))))


@query("f2_first_members", "t rank", "v", "model", views="s", sql="SELECT model, t, v, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY v DESC, t) AS k FROM s) WHERE k <= 3")
def _(spark, d):
    w = Window.partitionBy("model").orderBy(F.desc("v"), "t")
    return segment_month(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("f3_arg_extremum", "t", "v", "model", views="s", sql="SELECT model, arg_max(t, v) AS t, max(v) AS v FROM s GROUP BY model")
def _(spark, d):
    return segment_month(spark, d).groupBy("model").agg(F.max_by("t", "v").alias("t"), F.max("v").alias("v"))


@query("f4_refined_peak", "t", "place top", views="f", ctes="z AS (SELECT t, lat, avg(v) AS u FROM f GROUP BY ALL), n AS (SELECT *, lag(u) OVER w AS b, lead(u) OVER w AS a, coalesce(lead(lat) OVER w - lat, lat - lag(lat) OVER w) AS s FROM z WINDOW w AS (PARTITION BY t ORDER BY lat)), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY u DESC, lat) AS k FROM n) WHERE k = 1)", sql="SELECT t, lat + CASE WHEN b - 2 * u + a <> 0 THEN greatest(-1.0, least(1.0, 0.5 * (b - a) / (b - 2 * u + a))) ELSE 0 END * coalesce(s, 0) AS place, u AS top FROM m WHERE true")
def _(spark, d):
    rows = nation_month(spark, d).groupBy("t", "lat").agg(F.avg("v").alias("u"))
    return series.peak(rows, ["t"], "lat", "u").withColumnRenamed("at", "place")


@query("f5_top_quartile", "cell t", "v", views="f", sql="SELECT cell, t, v FROM (SELECT *, quantile_cont(v, 0.75) OVER (PARTITION BY t) AS q FROM f) WHERE v > q")
def _(spark, d):
    return nation_month(spark, d).withColumn("q", F.percentile("v", 0.75).over(Window.partitionBy("t"))).where("v > q")


@query("g1_concatenated_runs", "t", "v", "model", views="s", sql="SELECT model, t, v FROM (SELECT *, row_number() OVER (PARTITION BY model, t ORDER BY run) AS k FROM (SELECT 0 AS run, model, t, v FROM s WHERE year <= 1998 UNION ALL SELECT 1, model, t, v * 2 FROM s WHERE year >= 1998)) WHERE k = 1")
def _(spark, d):
    s = segment_month(spark, d)
    both = s.where("year <= 1998").withColumn("run", F.lit(0)).unionByName(s.where("year >= 1998").withColumn("v", F.col("v") * 2).withColumn("run", F.lit(1)))
    return both.withColumn("k", F.row_number().over(Window.partitionBy("model", "t").orderBy("run"))).where("k = 1")


@query("g2_common_times", "t", views="e", sql="SELECT t FROM e WHERE model = 'click' INTERSECT SELECT t FROM e WHERE model = 'purchase' EXCEPT SELECT t FROM e WHERE model = 'error'")
def _(spark, d):
    e = events_hour(spark, d)
    of = lambda m: e.where(F.col("model") == m).select("t")
    return of("click").intersect(of("purchase")).subtract(of("error"))


@query("c1_month_join", "n", "r", views="s p", ctes="j AS (SELECT a.v, p.y FROM (SELECT printf('%04d-%02d', year, month) AS ym, sum(v) AS v FROM s GROUP BY ALL) a JOIN (SELECT printf('%04d-%02d', year, month) AS ym, y FROM p) p USING (ym))", sql="SELECT count(*) AS n, corr(v, y) AS r FROM j")
def _(spark, d):
    ym = F.format_string("%04d-%02d", F.col("year").cast("int"), F.col("month").cast("int")).alias("ym")
    a = segment_month(spark, d).groupBy(ym).agg(F.sum("v").alias("v"))
    return a.join(ship_month(spark, d).select(ym, "y"), "ym").agg(F.count("*").alias("n"), scalar.safe_corr(F.col("v"), F.col("y")).alias("r"))


@query("c3_window_centre_join", "n", "r", views="s", ctes="ws AS (SELECT unnest(range(1995, 2000)) AS start), w AS (SELECT model, start + 1 AS centre, avg(v) AS v FROM s JOIN ws ON year BETWEEN start AND start + 2 GROUP BY ALL)", sql="SELECT count(*) AS n, corr(a.v, b.v) AS r FROM w a JOIN w b ON a.centre = b.centre AND a.model = 'BUILDING' AND b.model = 'MACHINERY'")
def _(spark, d):
    w = series.windows(segment_month(spark, d), ["model"], 3, 1, 1995, 2001)
    zipped = w.groupBy("model").agg(F.collect_list("centre").alias("centres"), F.collect_list("mean").alias("means"))  # a result document a model
    flat = zipped.select("model", F.explode(F.arrays_zip("centres", "means")).alias("z")).select("model", F.col("z.centres").alias("centre"), F.col("z.means").alias("v"))
    a, b = (flat.where(F.col("model") == m).select("centre", F.col("v").alias(c)) for m, c in (("BUILDING", "x"), ("MACHINERY", "y")))
    return a.join(b, "centre").agg(F.count("*").alias("n"), scalar.safe_corr(F.col("x"), F.col("y")).alias("r"))


@query("c4_nearest_time", "t place", "v", "model", ctes="l AS (SELECT n_name AS model, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT n_name AS model, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS t, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL), c AS (SELECT l.model, l.t, r.t AS place, r.v, row_number() OVER (PARTITION BY l.model, l.t ORDER BY abs(l.t - r.t) NULLS LAST, r.t) AS k FROM l LEFT JOIN r ON l.model = r.model AND abs(l.t - r.t) <= 2)", sql="SELECT model, t, coalesce(place, -1) AS place, v FROM c WHERE k = 1")
def _(spark, d):
    """All days on which a nation's customers order, with the shipped quantity of the nation's suppliers on the nearest day."""
    o, c, n, li, su = (table(spark, d, x) for x in ("orders", "customer", "nation", "lineitem", "supplier"))
    day = lambda x: F.datediff(F.col(x).cast("date"), F.lit("1995-01-01").cast("date")).alias("t")
    left = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("model"), day("o_orderdate")).distinct()
    right = li.join(su, li.l_suppkey == su.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("model"), day("l_shipdate")).agg(exact_sum("l_quantity").alias("v"))
    return series.nearest_time(left, right, ["model"], 2).withColumn("place", F.coalesce("at", F.lit(-1)))


@query("c8_complete_models", "n", "", "model", views="e", sql="SELECT model, count(DISTINCT t % 24) AS n FROM e GROUP BY model HAVING count(DISTINCT t % 24) = 24")
def _(spark, d):
    return events_hour(spark, d).groupBy("model").agg(F.count_distinct(F.col("t") % 24).alias("n")).where("n = 24")


@query("c10_fallback", "t source", "v", views="e", sql="SELECT t, 0 AS source, v FROM e WHERE model = 'error' UNION ALL SELECT t, 1, v FROM e WHERE model = 'view' AND t NOT IN (SELECT t FROM e WHERE model = 'error')")
def _(spark, d):
    e = events_hour(spark, d)
    first = e.where("model = 'error'").select("t", F.lit(0).alias("source"), "v")
    second = e.where("model = 'view'").select("t", F.lit(1).alias("source"), "v").join(first.select("t"), "t", "left_anti")
    return first.unionByName(second)


@query("c14_parameter_grid", "k", "u tau", ctes="ks AS (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS k FROM orders), us AS (SELECT DISTINCT l_discount AS u FROM lineitem WHERE l_discount > 0)", sql="SELECT k, u, 1 / sqrt(1 + k * u) AS tau FROM ks, us")
def _(spark, d):
    """Every pair of two parameters, each as many as a table has different ones."""
    k = table(spark, d, "orders").select(F.substring("o_orderpriority", 1, 1).cast("long").alias("k")).distinct()
    u = table(spark, d, "lineitem").select(F.col("l_discount").alias("u")).where("u > 0").distinct()
    return k.crossJoin(u).select("k", "u", scalar.closure_simple(F.col("u"), F.col("k")).alias("tau"))  # the grid is what is asked for


@query("h3_calendar", "t n", "year_part", "ym", views="p", sql="SELECT t, printf('%04d-%02d', year, month) AS ym, year + (month - 0.5) / 12 AS year_part, day(last_day(make_date(year, month, 1))) AS n FROM p")
def _(spark, d):
    ym = F.format_string("%04d-%02d", F.col("year").cast("int"), F.col("month").cast("int")).alias("ym")
    return ship_month(spark, d).select("t", ym, scalar.decimal_year(F.col("year"), F.col("month")).alias("year_part"), F.dayofmonth(F.last_day(F.make_date("year", "month", F.lit(1)))).alias("n"))


@query("h6_wrapped_difference", "t", "d", "model", views="s", sql="SELECT model, t, atan2(sin(v - lag(v) OVER w), cos(v - lag(v) OVER w)) AS d FROM s WINDOW w AS (PARTITION BY model ORDER BY t)")
def _(spark, d):
    return segment_month(spark, d).select("model", "t", scalar.wrapped(F.col("v") - F.lag("v").over(series.ordered(["model"]))).alias("d"))


@query("h10_co2_growth", "year", "ppm", views="p", sql="SELECT DISTINCT year, 284.32 * pow(1.01, year - 1995) AS ppm FROM p")
def _(spark, d):
    return ship_month(spark, d).select("year", scalar.co2_ppm(F.col("year") - 1995).alias("ppm")).distinct()


@query("h11_zscore", "t", "z", "model", views="s", sql="SELECT model, t, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM s WINDOW w AS (PARTITION BY model)")
def _(spark, d):
    return segment_month(spark, d).select("model", "t", scalar.zscore(F.col("v"), Window.partitionBy("model")).alias("z"))


@query("h12_table_lookup", "t", "v", views="p", ctes="k AS (SELECT * FROM (VALUES (0, 10.0), (20, 14.0), (60, 6.0), (100, 8.0)) x(a, q)), seg AS (SELECT a, q, lead(a) OVER (ORDER BY a) AS na, lead(q) OVER (ORDER BY a) AS nq FROM k)", sql="SELECT t, q + (nq - q) * (t - a) / (na - a) AS v FROM p JOIN seg ON t >= a AND t < na")
def _(spark, d):
    knots = [(0, 10.0), (20, 14.0), (60, 6.0), (100, 8.0)]
    cases = None
    for (a, q), (na, nq) in zip(knots, knots[1:], strict=False):
        inside, value = (F.col("t") >= a) & (F.col("t") < na), q + (nq - q) * (F.col("t") - a) / (na - a)
        cases = F.when(inside, value) if cases is None else cases.when(inside, value)
    return ship_month(spark, d).select("t", cases.alias("v")).where("v IS NOT NULL")


@query("h15_verdict", "t", "v", "verdict", views="p", sql="SELECT t, z AS v, CASE WHEN z < 0.049 THEN 'falsified' WHEN z <= 0.05 THEN 'deferred' WHEN z > 0.05 THEN 'supported' END AS verdict FROM p")
def _(spark, d):
    return ship_month(spark, d).select("t", F.col("z").alias("v"), scalar.band_verdict(F.col("z"), 0.049, 0.05).alias("verdict"))


@query("i1_detrend", "cell t", "d", views="f", sql="SELECT cell, t, v - avg(v) OVER w - covar_pop(v, t) OVER w / var_pop(t) OVER w * (t - avg(t) OVER w) AS d FROM f WINDOW w AS (PARTITION BY cell)")
def _(spark, d):
    return series.detrend(nation_month(spark, d), ["cell"])


LANCZOS = series.lanczos_weights(10, 1 / 24, 1 / 6)
GAUSS = series.gaussian_weights(2.0)


def _frame(weights: list[float]) -> str:
    n = len(weights) // 2
    return " + ".join(f"{w!r}::DOUBLE * " + (f"lag(v, {n - i}) OVER w" if i < n else f"lead(v, {i - n}) OVER w" if i > n else "v") for i, w in enumerate(weights))


@query("i4_lanczos", "t", "f", "model", views="s", sql=f"SELECT model, t, {_frame(LANCZOS)} AS f FROM s WINDOW w AS (PARTITION BY model ORDER BY t)")
def _(spark, d):
    return series.weighted_frame(segment_month(spark, d), ["model"], LANCZOS)


@query("i5_gaussian", "t", "f", "model", views="s", sql=f"SELECT model, t, {_frame(GAUSS)} AS f FROM s WINDOW w AS (PARTITION BY model ORDER BY t)")
def _(spark, d):
    return series.weighted_frame(segment_month(spark, d), ["model"], GAUSS)


@query("i8_frequency", "", "omega", "model", views="s", ctes="q AS (SELECT model, t, atan2(sin(t * 0.7 + v), cos(t * 0.7 + v)) AS phase FROM s), st AS (SELECT *, phase - lag(phase) OVER (PARTITION BY model ORDER BY t) AS s FROM q), u AS (SELECT model, t, sum(coalesce(atan2(sin(s), cos(s)), 0)) OVER (PARTITION BY model ORDER BY t ROWS UNBOUNDED PRECEDING) AS u FROM st), gr AS (SELECT model, coalesce((lead(u) OVER w - lag(u) OVER w) / 2, lead(u) OVER w - u, u - lag(u) OVER w) AS g FROM u WINDOW w AS (PARTITION BY model ORDER BY t))", sql="SELECT model, avg(g) * 12 / (2 * pi()) AS omega FROM gr GROUP BY model")
def _(spark, d):
    rows = segment_month(spark, d).withColumn("phase", scalar.wrapped(F.col("t") * 0.7 + F.col("v")))
    return series.frequency(rows, ["model"], 12)


AC = "c AS (SELECT *, v - avg(v) OVER (PARTITION BY model) AS c FROM s), l AS (SELECT *, lag(c) OVER (PARTITION BY model ORDER BY t) AS q, lag(v) OVER (PARTITION BY model ORDER BY t) AS u FROM c)"
for _name, _e in (("mean", "avg(c * q) / var_pop(v)"), ("sum", "sum(c * q) / sum(c * c)"), ("pearson", "corr(v, u)")):

    @query(f"i11_lag1_{_name}", "", "ac1", "model", views="s", ctes=AC, sql=f"SELECT model, {_e} AS ac1 FROM l GROUP BY model")
    def _(spark, d, name=_name):
        return series.lag1_products(segment_month(spark, d), ["model"], name)


@query("i11_lag1_present", "", "ac1", "model", views="s", ctes="g AS (SELECT model, t, v FROM s WHERE month <> 7), l AS (SELECT model, v, lag(v) OVER (PARTITION BY model ORDER BY t) AS u FROM g)", sql="SELECT model, corr(v, u) AS ac1 FROM l GROUP BY model")
def _(spark, d):
    gaps = segment_month(spark, d).withColumn("v", F.when(F.col("month") != 7, F.col("v")))
    return series.lag1_products(gaps, ["model"], "present")


@query("i12_binary_transfer_entropy", "", "bits", views="p", ctes="q AS (SELECT t, CASE WHEN x > quantile_cont(x, 0.5) OVER () THEN 1 ELSE 0 END AS b, CASE WHEN z > quantile_cont(z, 0.5) OVER () THEN 1 ELSE 0 END AS c FROM p), r AS (SELECT *, lead(b) OVER (ORDER BY t) AS a FROM q), n AS (SELECT a, b, c, CAST(count(*) AS DOUBLE) AS n FROM r WHERE a IS NOT NULL GROUP BY ALL), m AS (SELECT n, sum(n) OVER () AS al, sum(n) OVER (PARTITION BY b, c) AS bc, sum(n) OVER (PARTITION BY a, b) AS ab, sum(n) OVER (PARTITION BY b) AS b1 FROM n)", sql="SELECT sum(n / al * log2(n * b1 / (bc * ab))) AS bits FROM m")
def _(spark, d):
    rows = ship_month(spark, d).select(F.lit(0).alias("g"), "t", F.col("x").alias("target"), F.col("z").alias("source"))
    return series.binary_transfer_entropy(rows, ["g"])


@query("i14_drift", "", "drift", "model", views="s", sql="SELECT model, abs(regr_slope(v, t)) * 12 AS drift FROM s GROUP BY model")
def _(spark, d):
    return series.drift(segment_month(spark, d), ["model"])


@query("i15_box_index", "t", "v", views="f", sql="SELECT t, avg(CASE WHEN lon <= -56 THEN v END) - avg(CASE WHEN lon >= -48 THEN v END) AS v FROM f GROUP BY t")
def _(spark, d):
    return nation_month(spark, d).groupBy("t").agg((F.avg(F.when(F.col("lon") <= -56, F.col("v"))) - F.avg(F.when(F.col("lon") >= -48, F.col("v")))).alias("v"))
