"""Queries on tests, resampling, regressions and decisions (2.D, 2.L, 2.M, 2.N)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import scalar
from tesserae.operators import series, stats, trends
from tesserae.queries import query
from tesserae.sources.fields import nation_month, segment_month, ship_month

PAIRS = "pr AS (SELECT a.model, b.t - a.t AS dt, b.v - a.v AS dv FROM s a JOIN s b ON a.model = b.model AND a.t < b.t)"
DRAW = "((((({r} * 7919 + {k} * 104729 + 7 * 15485863) % 2147483647) * 48271) % 2147483647 * 69621 + {r}) % 2147483647) % {n}"


def indexed(spark, d):
    w = Window.partitionBy(F.lit(1)).orderBy("t")  # one series of months
    return ship_month(spark, d).withColumn("i", (F.row_number().over(w) - 1).cast("long"))


@query("d13_ensemble_band", "t n", "low mid high", views="f", sql="SELECT t, count(v) AS n, quantile_cont(v, 0.16) AS low, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.84) AS high FROM f GROUP BY t")
def _(spark, d):
    return stats.band(nation_month(spark, d), ["t"])


@query("d14_spreads", "cell", "pop samp", views="f", sql="SELECT cell, stddev_pop(v) AS pop, stddev_samp(v) AS samp FROM f GROUP BY cell")
def _(spark, d):
    return nation_month(spark, d).groupBy("cell").agg(F.stddev_pop("v").alias("pop"), F.stddev_samp("v").alias("samp"))


@query("d15_pearson", "n", "r", views="p", sql="SELECT count(*) AS n, corr(x, z) AS r FROM p")
def _(spark, d):
    return ship_month(spark, d).agg(F.count("*").alias("n"), scalar.safe_corr(F.col("x"), F.col("z")).alias("r"))


@query("d18_sign_agreement", "t", "agreement mean", views="f", ctes="a AS (SELECT t, v - avg(v) OVER (PARTITION BY cell) AS v FROM f)", sql="SELECT t, greatest(count(*) FILTER (v > 0), count(*) FILTER (v < 0)) / count(v) AS agreement, avg(v) AS mean FROM a GROUP BY t")
def _(spark, d):
    rows = nation_month(spark, d).withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("cell")))
    return stats.sign_agreement(rows, ["t"])


@query("d22_cohort_summary", "n", "low mid mean high", "cohort", views="s", sql="SELECT substr(model, 1, 1) AS cohort, count(*) AS n, min(v) AS low, quantile_cont(v, 0.5) AS mid, avg(v) AS mean, max(v) AS high FROM s GROUP BY ALL")
def _(spark, d):
    return segment_month(spark, d).groupBy(F.substring("model", 1, 1).alias("cohort")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.percentile("v", 0.5).alias("mid"), F.avg("v").alias("mean"), F.max("v").alias("high"))


@query("d23_passing_share", "n", "share", "model", views="s", sql="SELECT model, count(*) FILTER (v > 40) AS n, avg(CASE WHEN v > 40 THEN 1.0 ELSE 0.0 END) AS share FROM s GROUP BY model")
def _(spark, d):
    return segment_month(spark, d).groupBy("model").agg(F.count_if(F.col("v") > 40).alias("n"), F.avg((F.col("v") > 40).cast("double")).alias("share"))


#: Every month of the calendar of every nation, without a value where there were no orders.
CALENDAR = "mo AS (SELECT unnest(range((SELECT min(t) FROM f), (SELECT max(t) + 1 FROM f))) AS t), ce AS (SELECT DISTINCT cell FROM f), ca AS (SELECT ce.cell, mo.t, f.v FROM ce CROSS JOIN mo LEFT JOIN f ON f.cell = ce.cell AND f.t = mo.t)"


def calendar(spark, d):
    f = nation_month(spark, d).select("cell", "t", "v")
    span = f.agg(F.sequence(F.min("t"), F.max("t")).alias("ts"))  # one row
    months = f.select("cell").distinct().crossJoin(F.broadcast(span)).select("cell", F.explode("ts").alias("t"))
    return months.join(f, ["cell", "t"], "left")


@query("d24_empirical_cdf", "cell t", "v cdf", views="f", ctes=CALENDAR, sql="SELECT cell, t, v, row_number() OVER (ORDER BY v, cell, t) / (SELECT count(*) FROM ca) AS cdf FROM ca WHERE v IS NOT NULL")
def _(spark, d):
    return stats.empirical_cdf(calendar(spark, d), "v")


@query("d26_corridor", "n", "p05 p95", "model", views="s", sql="SELECT model, count(*) AS n, quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.95) AS p95 FROM s WHERE year <= 1998 GROUP BY model")
def _(spark, d):
    q = F.percentile("v", [0.05, 0.95])
    return segment_month(spark, d).where("year <= 1998").groupBy("model").agg(F.count("*").alias("n"), q[0].alias("p05"), q[1].alias("p95"))


@query("e4_sliding_sen", "start n", "slope", "model", views="s", ctes="ws AS (SELECT unnest(range(-36, 100, 12)) AS start), w AS (SELECT model, start, t, v FROM s JOIN ws ON t >= start AND t <= start + 36), c AS (SELECT model, start, count(*) AS n FROM w GROUP BY ALL HAVING count(*) >= 3), sl AS (SELECT a.model, a.start, quantile_cont((b.v - a.v) / (b.t - a.t), 0.5) AS slope FROM w a JOIN w b ON a.model = b.model AND a.start = b.start AND a.t < b.t GROUP BY ALL)", sql="SELECT model, start, n, slope FROM sl JOIN c USING (model, start)")
def _(spark, d):
    return stats.sliding_sen(segment_month(spark, d), ["model"], 36, 12)


@query("e11_ranks", "t rank", "average", "model", views="s", ctes="q AS (SELECT model, t, floor(v / 5) AS v FROM s)", sql="SELECT model, t, rank() OVER (PARTITION BY model ORDER BY v) AS rank, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2 AS average FROM q")
def _(spark, d):
    q = segment_month(spark, d).withColumn("v", F.floor(F.col("v") / 5))
    return q.withColumn("rank", F.rank().over(Window.partitionBy("model").orderBy("v"))).withColumn("average", stats.average_rank(F.col("v"), ["model"], ["v"]))


@query("l3_circular_bootstrap", "", "low high median", views="p", ctes=f"x AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM p), rp AS (SELECT r, k, o, k * 12 + o AS place, n, ({DRAW.format(r='r', k='k', n='n')} + o) % n AS i FROM (SELECT max(n) AS n FROM x), (SELECT unnest(range(0, 200)) AS r), (SELECT unnest(range(0, 50)) AS k), (SELECT unnest(range(0, 12)) AS o) WHERE k < ceil(n / 12) AND k * 12 + o < n), c AS (SELECT r, corr(x.x, x.z) AS c FROM rp JOIN x ON rp.i = x.i GROUP BY r)", sql="SELECT quantile_cont(c, 0.025) AS low, quantile_cont(c, 0.975) AS high, quantile_cont(c, 0.5) AS median FROM c")
def _(spark, d):
    rows = stats.resampled(spark, indexed(spark, d), 200, 12)
    return stats.interval(rows.groupBy("replicate").agg(scalar.safe_corr(F.col("x"), F.col("z")).alias("c")), "c", level=0.95)


@query("l4_trend_bootstrap", "", "slope p", views="p", ctes=f"x AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM p), rp AS (SELECT r, k * 12 + o AS place, ({DRAW.format(r='r', k='k', n='n')} + o) % n AS i FROM (SELECT max(n) AS n FROM x), (SELECT unnest(range(0, 200)) AS r), (SELECT unnest(range(0, 50)) AS k), (SELECT unnest(range(0, 12)) AS o) WHERE k < ceil(n / 12) AND k * 12 + o < n), c AS (SELECT r, regr_slope(x.y, place) AS c FROM rp JOIN x ON rp.i = x.i GROUP BY r), o AS (SELECT regr_slope(y, t) AS slope FROM p)", sql="SELECT slope, least(1.0, 2 * least(avg(CASE WHEN c + slope <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN c + slope >= 0 THEN 1.0 ELSE 0.0 END))) AS p FROM c, o GROUP BY slope")
def _(spark, d):
    x = indexed(spark, d)
    slope = x.agg(F.regr_slope("y", F.col("t").cast("double")).alias("slope"))
    reps = stats.resampled(spark, x, 200, 12).groupBy("replicate").agg(F.regr_slope("y", F.col("place").cast("double")).alias("c")).crossJoin(F.broadcast(slope))
    share = lambda c: F.avg(c.cast("double"))
    s = F.col("c") + F.col("slope")
    return reps.groupBy("slope").agg(F.least(F.lit(1.0), 2 * F.least(share(s <= 0), share(s >= 0))).alias("p"))


@query("l5_moving_bootstrap", "n", "low high", views="p", ctes=f"x AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM p), rp AS (SELECT r, {DRAW.format(r='r', k='k', n='(n - 30 + 1)')} + o AS i FROM (SELECT max(n) AS n FROM x), (SELECT unnest(range(0, 200)) AS r), (SELECT unnest(range(0, 50)) AS k), (SELECT unnest(range(0, 30)) AS o) WHERE k < floor(n / 30)), c AS (SELECT r, avg(x.y) AS c, count(*) AS n FROM rp JOIN x ON rp.i = x.i GROUP BY r)", sql="SELECT max(n) AS n, quantile_cont(c, 0.025) AS low, quantile_cont(c, 0.975) AS high FROM c")
def _(spark, d):
    reps = stats.resampled(spark, indexed(spark, d), 200, 30, wrap=False).groupBy("replicate").agg(F.avg("y").alias("c"), F.count("*").alias("n"))
    return reps.agg(F.max("n").alias("n"), F.percentile("c", 0.025).alias("low"), F.percentile("c", 0.975).alias("high"))


@query("l6_iid_bootstrap", "", "low high median", views="p", ctes=f"x AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM p), rp AS (SELECT r, {DRAW.format(r='r', k='k', n='n')} AS i FROM (SELECT max(n) AS n FROM x), (SELECT unnest(range(0, 200)) AS r), (SELECT unnest(range(0, 2000)) AS k) WHERE k < n), c AS (SELECT r, quantile_cont(x.y, 0.5) AS c FROM rp JOIN x ON rp.i = x.i GROUP BY r)", sql="SELECT quantile_cont(c, 0.025) AS low, quantile_cont(c, 0.975) AS high, quantile_cont(c, 0.5) AS median FROM c")
def _(spark, d):
    rows = stats.resampled(spark, indexed(spark, d), 200, 1)
    return stats.interval(rows.groupBy("replicate").agg(F.percentile("y", 0.5).alias("c")), "c")


@query("l7_jackknife", "", "median", "without", views="s", ctes="m AS (SELECT model, avg(v) AS v FROM s GROUP BY model)", sql="SELECT a.model AS without, quantile_cont(b.v, 0.5) AS median FROM m a JOIN m b ON a.model <> b.model GROUP BY a.model")
def _(spark, d):
    return stats.jackknife_median(segment_month(spark, d).groupBy("model").agg(F.avg("v").alias("v")), "model", "v")


@query("l8_mann_kendall", "n", "s var z sen", "model", views="s", ctes=PAIRS + ", k AS (SELECT model, sum(sign(dv)) AS s, quantile_cont(dv / dt, 0.5) AS sen FROM pr GROUP BY model), g AS (SELECT model, v, count(*) AS g FROM s GROUP BY ALL), q AS (SELECT model, sum(g) AS n, sum(g * (g - 1) * (2 * g + 5)) AS tie FROM g GROUP BY model), r AS (SELECT *, (n * (n - 1) * (2 * n + 5) - tie) / 18 AS var FROM k JOIN q USING (model))", sql="SELECT model, n, s, var, CASE WHEN s > 0 THEN (s - 1) / sqrt(var) WHEN s < 0 THEN (s + 1) / sqrt(var) ELSE 0 END AS z, sen FROM r")
def _(spark, d):
    return stats.mann_kendall(segment_month(spark, d), ["model"])


@query("l9_sen_slope", "", "sen", "model", views="s", ctes=PAIRS, sql="SELECT model, quantile_cont(dv / dt, 0.5) AS sen FROM pr GROUP BY model")
def _(spark, d):
    return trends.pair_trends(segment_month(spark, d), ["model"]).select("model", "sen")


@query("l10_kendall_tau", "", "tau", "model", views="s", ctes=PAIRS, sql="SELECT model, sum(sign(dv)) / sqrt(count(*) * CAST(count(*) FILTER (dv <> 0) AS DOUBLE)) AS tau FROM pr GROUP BY model")
def _(spark, d):
    return stats.kendall_tau(segment_month(spark, d), ["model"])


@query("l11_fdr", "cell t", "p q", views="f", ctes=CALENDAR + ", te AS (SELECT cell, t, round(v - floor(v), 3) AS p FROM ca), r AS (SELECT *, p * count(p) OVER () / row_number() OVER (PARTITION BY p IS NULL ORDER BY p) AS w FROM te)", sql="SELECT cell, t, p, CASE WHEN p IS NOT NULL THEN least(1.0, min(w) OVER (PARTITION BY p IS NULL ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM r")
def _(spark, d):
    return stats.fdr(calendar(spark, d).select("cell", "t", F.round(F.col("v") - F.floor("v"), 3).alias("p")))


@query("l12_mann_whitney", "n1 n2", "u", views="f", ctes="m AS (SELECT cell, cell % 2 AS side, avg(v) AS v FROM f GROUP BY ALL), r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM m)", sql="SELECT count(*) FILTER (side = 1) AS n1, count(*) FILTER (side <> 1) AS n2, sum(CASE WHEN side = 1 THEN r END) - count(*) FILTER (side = 1) * (count(*) FILTER (side = 1) + 1) / 2 AS u FROM r")
def _(spark, d):
    m = nation_month(spark, d).groupBy("cell").agg(F.avg("v").alias("v")).withColumn("side", F.col("cell") % 2)
    return stats.mann_whitney(m, "side", 1)


@query("l12_spearman", "n", "rho", views="p", ctes="r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2 AS b FROM p)", sql="SELECT count(*) AS n, corr(a, b) AS rho FROM r")
def _(spark, d):
    return stats.spearman(ship_month(spark, d).select(F.lit(0).alias("g"), "x", F.col("z").alias("y")), ["g"])


@query("l13_unprecedented", "", "modern z", "verdict", views="s", ctes="ws AS (SELECT unnest(range(0, 72, 6)) AS start), w AS (SELECT start, t, sum(v) AS v FROM s JOIN ws ON t >= start AND t <= start + 12 GROUP BY ALL), sl AS (SELECT a.start, quantile_cont((b.v - a.v) / (b.t - a.t), 0.5) AS slope FROM w a JOIN w b ON a.start = b.start AND a.t < b.t GROUP BY ALL)", sql="SELECT m.slope AS modern, (m.slope - avg(h.slope)) / stddev_pop(h.slope) AS z, CASE WHEN abs((m.slope - avg(h.slope)) / stddev_pop(h.slope)) > 3 THEN 'unprecedented' ELSE 'within' END AS verdict FROM sl m, sl h WHERE m.start = 66 AND h.start < 54 GROUP BY m.slope")
def _(spark, d):
    total = segment_month(spark, d).groupBy("t").agg(F.sum("v").alias("v")).withColumn("g", F.lit(0))
    sl = stats.sliding_sen(total, ["g"], 12, 6).where("start BETWEEN 0 AND 66")
    out = sl.agg(F.max(F.when(F.col("start") == 66, F.col("slope"))).alias("modern"), F.avg(F.when(F.col("start") < 54, F.col("slope"))).alias("m"), F.stddev_pop(F.when(F.col("start") < 54, F.col("slope"))).alias("sd"))
    z = (F.col("modern") - F.col("m")) / F.col("sd")
    return out.select("modern", z.alias("z"), F.when(F.abs(z) > 3, "unprecedented").otherwise("within").alias("verdict"))


@query("l14_exceedance", "", "x share", "name verdict", views="f s", ctes="c AS (SELECT cell, regr_slope(v, t) AS v FROM f GROUP BY cell), ob AS (SELECT model AS name, regr_slope(v, t) / 5 AS x FROM s GROUP BY model)", sql="SELECT name, x, avg(CASE WHEN v <= x THEN 1.0 ELSE 0.0 END) AS share, CASE WHEN avg(CASE WHEN v <= x THEN 1.0 ELSE 0.0 END) <= 0.01 THEN 'detected' WHEN avg(CASE WHEN v <= x THEN 1.0 ELSE 0.0 END) <= 0.05 THEN 'likely' ELSE 'within' END AS verdict FROM c, ob GROUP BY ALL")
def _(spark, d):
    t = F.col("t").cast("double")
    control = nation_month(spark, d).groupBy("cell").agg(F.regr_slope("v", t).alias("v"))
    seen = segment_month(spark, d).groupBy(F.col("model").alias("name")).agg((F.regr_slope("v", t) / 5).alias("x"))
    return stats.exceedance(control, seen)


@query("l16_effective_n", "", "n_eff low high", "model", views="s", ctes="l AS (SELECT model, v, t, lag(v) OVER (PARTITION BY model ORDER BY t) AS q FROM s), a AS (SELECT model, count(*) AS n, greatest(-0.95, least(0.95, corr(v, q))) AS r1, corr(v, t) AS r FROM l GROUP BY model), e AS (SELECT *, greatest(5.0, n * (1 - r1 * r1) / (1 + r1 * r1)) AS n_eff FROM a)", sql="SELECT model, n_eff, tanh(atanh(r) - 1.959963984540054 / sqrt(n_eff - 3)) AS low, tanh(atanh(r) + 1.959963984540054 / sqrt(n_eff - 3)) AS high FROM e")
def _(spark, d):
    s = segment_month(spark, d).withColumn("q", F.lag("v").over(series.ordered(["model"])))
    a = s.groupBy("model").agg(F.count("*").alias("n"), scalar.safe_corr(F.col("v"), F.col("q")).alias("r1"), scalar.safe_corr(F.col("v"), F.col("t").cast("double")).alias("r"))
    a = a.withColumn("n_eff", stats.effective_n(F.col("n"), F.col("r1"), F.col("r1")))
    low, high = stats.fisher_interval(F.col("r"), F.col("n_eff"))
    return a.select("model", "n_eff", low.alias("low"), high.alias("high"))


@query("m1_partial_correlation", "n", "r", views="p", ctes="c AS (SELECT count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM p)", sql="SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r FROM c")
def _(spark, d):
    return stats.partial_correlation(ship_month(spark, d).withColumn("g", F.lit(0)), ["g"])


@query("m2_lead_lag_regression", "lag n", "slope", views="p", ctes="r AS (SELECT t, x - avg(x) OVER () - covar_pop(x, z) OVER () / var_pop(z) OVER () * (z - avg(z) OVER ()) AS x, y - avg(y) OVER () - covar_pop(y, z) OVER () / var_pop(z) OVER () * (z - avg(z) OVER ()) AS y FROM p), lg AS (SELECT unnest(range(-3, 4)) AS lag)", sql="SELECT lag, count(*) AS n, regr_slope(b.y, a.x) AS slope FROM r a JOIN lg ON true JOIN r b ON b.t = a.t + lag GROUP BY lag HAVING count(*) >= 10", places=5)
def _(spark, d):
    rows = ship_month(spark, d).withColumn("g", F.lit(0))
    rows = stats.residual(stats.residual(rows, ["g"], "x", "z", "rx"), ["g"], "y", "z", "ry")
    a = rows.select("g", "rx", "t", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("lag")).withColumn("u", F.col("t") + F.col("lag"))
    b = rows.select("g", F.col("t").alias("u"), "ry")
    return a.join(b, ["g", "u"]).groupBy("lag").agg(F.count("*").alias("n"), F.regr_slope("ry", "rx").alias("slope")).where("n >= 10")


@query("m4_m5_commonality", "", "only_x only_z shared left_over", views="p", ctes="c AS (SELECT corr(x, y) AS xy, corr(z, y) AS zy, corr(x, z) AS xz FROM p), b AS (SELECT *, (xy * xy + zy * zy - 2 * xy * zy * xz) / (1 - xz * xz) AS b FROM c)", sql="SELECT greatest(0, b - zy * zy) AS only_x, greatest(0, b - xy * xy) AS only_z, greatest(0, xy * xy + zy * zy - b) AS shared, greatest(0, 1 - b) AS left_over FROM b")
def _(spark, d):
    return stats.commonality(ship_month(spark, d).withColumn("g", F.lit(0)), ["g"])


@query("m4_cell_variance", "cell n", "joint only_x only_z", views="f p", ctes="j AS (SELECT cell, f.v AS y, x, z FROM f JOIN p ON f.t = p.t), c AS (SELECT cell, count(*) AS n, corr(x, y) AS xy, corr(z, y) AS zy, corr(x, z) AS xz FROM j GROUP BY cell)", sql="SELECT cell, n, (xy * xy + zy * zy - 2 * xy * zy * xz) / (1 - xz * xz) AS joint, xy * xy AS only_x, zy * zy AS only_z FROM c")
def _(spark, d):
    """Each cell's variance explained by either series alone and by both."""
    rows = nation_month(spark, d).select("cell", "t", F.col("v").alias("y")).join(ship_month(spark, d).select("t", "x", "z"), "t")
    c = rows.groupBy("cell").agg(F.count("*").alias("n"), scalar.safe_corr(F.col("x"), F.col("y")).alias("xy"), scalar.safe_corr(F.col("z"), F.col("y")).alias("zy"), scalar.safe_corr(F.col("x"), F.col("z")).alias("xz"))
    joint = (F.pow("xy", 2) + F.pow("zy", 2) - 2 * F.col("xy") * F.col("zy") * F.col("xz")) / (1 - F.pow("xz", 2))
    return c.select("cell", "n", joint.alias("joint"), F.pow("xy", 2).alias("only_x"), F.pow("zy", 2).alias("only_z"))


@query("m8_density", "gx gy", "density", views="p", ctes="st AS (SELECT stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM p), gr AS (SELECT a AS gx, b AS gy FROM (SELECT unnest(range(0, 40, 10)) AS a), (SELECT unnest(range(0, 100, 20)) AS b))", sql="SELECT gx, gy, avg(exp(-0.5 * (pow((x - gx) / (sx * 0.3), 2) + pow((y - gy) / (sy * 0.3), 2)))) / (2 * 3.141592653589793 * max(sx) * max(sy) * 0.09) AS density FROM p, st, gr GROUP BY gx, gy")
def _(spark, d):
    places = spark.range(0, 40, 10).withColumnRenamed("id", "gx").crossJoin(spark.range(0, 100, 20).withColumnRenamed("id", "gy"))  # a stated grid
    return stats.density(ship_month(spark, d), places, 0.3)


@query("m9_epoch_trends", "epoch", "slope", "model", views="s", sql="SELECT model, year // 3 AS epoch, regr_slope(v, t) AS slope FROM s GROUP BY ALL")
def _(spark, d):
    return segment_month(spark, d).groupBy("model", F.floor(F.col("year") / 3).alias("epoch")).agg(F.regr_slope("v", F.col("t").cast("double")).alias("slope"))


@query("m10_emergent_subset", "n", "low mid high", views="f", ctes="sl AS (SELECT cell, regr_slope(v, t) AS b, avg(v) AS v FROM f GROUP BY cell), kp AS (SELECT v FROM sl WHERE abs(b - (SELECT avg(b) FROM sl)) <= (SELECT stddev_pop(b) FROM sl))", sql="SELECT count(*) AS n, quantile_cont(v, 0.16) AS low, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.84) AS high FROM kp")
def _(spark, d):
    sl = nation_month(spark, d).groupBy("cell").agg(F.regr_slope("v", F.col("t").cast("double")).alias("b"), F.avg("v").alias("v"))
    seen = sl.agg(F.avg("b").alias("m"), F.stddev_pop("b").alias("sd"))
    return stats.band(sl.crossJoin(F.broadcast(seen)).where(F.abs(F.col("b") - F.col("m")) <= F.col("sd")), [])


@query("m11_underestimation", "", "factor", "model", views="s", ctes="ws AS (SELECT unnest(range(1995, 2000)) AS start), w AS (SELECT model, start, avg(v) AS q FROM s JOIN ws ON year BETWEEN start AND start + 2 GROUP BY ALL), l AS (SELECT model, q, row_number() OVER (PARTITION BY model ORDER BY start DESC) AS k FROM w)", sql="SELECT model, least(10.0, 60.0 / nullif(quantile_cont(q, 0.5), 0)) AS factor FROM l WHERE k <= 3 GROUP BY model")
def _(spark, d):
    w = series.windows(segment_month(spark, d), ["model"], 3, 1, 1995, 2001)
    last = w.groupBy("model").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("start", "mean"))), lambda x: x["mean"]), -3, 3).alias("q"))
    return last.select("model", F.explode("q").alias("q")).groupBy("model").agg(F.least(F.lit(10.0), F.try_divide(F.lit(60.0), F.percentile("q", 0.5))).alias("factor"))


@query("n4_corridor_exit", "exit", "threshold", "model", views="s", ctes="ws AS (SELECT unnest(range(1995, 2001)) AS start), w AS (SELECT model, start, avg(v) AS q FROM s JOIN ws ON year BETWEEN start AND start + 1 GROUP BY ALL), th AS (SELECT model, quantile_cont(v, 0.5) AS threshold FROM s WHERE year <= 1997 GROUP BY model)", sql="SELECT model, threshold, coalesce(min(CASE WHEN q > threshold THEN start + 1 END), -1) AS exit FROM w JOIN th USING (model) GROUP BY ALL")
def _(spark, d):
    s = segment_month(spark, d)
    threshold = s.where("year <= 1997").groupBy("model").agg(F.percentile("v", 0.5).alias("threshold"))
    w = series.windows(s, ["model"], 2, 1, 1995, 2001)
    return w.join(threshold, "model").groupBy("model", "threshold").agg(F.coalesce(F.min(F.when(F.col("mean") > F.col("threshold"), F.col("centre"))), F.lit(-1)).alias("exit"))


@query("n6_stationarity_audit", "passed failed", "", "failing", views="s", ctes=PAIRS + ", t AS (SELECT model, abs(sum(sign(dv))) / count(*) AS tau FROM pr GROUP BY model)", sql="SELECT count(*) FILTER (tau < 0.1) AS passed, count(*) FILTER (tau >= 0.1) AS failed, coalesce(string_agg(CASE WHEN tau >= 0.1 THEN model END, ',' ORDER BY model), '') AS failing FROM t")
def _(spark, d):
    t = trends.pair_trends(segment_month(spark, d), ["model"]).select("model", (F.abs("rises") / F.col("every")).alias("tau"))
    return t.agg(F.count_if(F.col("tau") < 0.1).alias("passed"), F.count_if(F.col("tau") >= 0.1).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("tau") >= 0.1, F.col("model")))), ",").alias("failing"))


@query("c9_admitted_models", "t", "v", "model", views="s", ctes=PAIRS + ", t AS (SELECT model FROM pr GROUP BY model HAVING abs(sum(sign(dv))) / count(*) < 0.1)", sql="SELECT model, t, v FROM s WHERE model IN (SELECT model FROM t)")
def _(spark, d):
    s = segment_month(spark, d)
    steady = trends.pair_trends(s, ["model"]).select("model", (F.abs("rises") / F.col("every")).alias("tau")).where("tau < 0.1")
    return s.join(steady, "model", "left_semi")
