"""Queries on least squares by aggregates (2.M). Their DuckDB texts take predictors out of each other one after the other instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import regress
from tesserae.queries import query
from tesserae.sources.fields import nation_month, segment_month, ship_month

LAG = 4


def t_p_sql(angle: str, dof: str) -> str:
    """Two-sided p of Student's t in SQL, of the angle whose tangent is |t| / sqrt(dof): finite sums whose terms are ratios of gamma functions."""
    odd = f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce(list_sum(list_transform(range(0, ({dof} - 1) // 2), lambda j: pow(cos({angle}), 2 * j) * exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * sqrt(pi()) / 2)), 0))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, {dof} // 2), lambda j: pow(cos({angle}), 2 * j) * exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi())))"
    return f"greatest(0, 1 - CASE WHEN {dof} % 2 = 1 THEN {odd} ELSE {even} END)"


#: Slope of y on x beside z and its error, of rg (key, t, y, x, z).
NEWEY_WEST = f"""c0 AS (SELECT *, x - avg(x) OVER w AS xc, z - avg(z) OVER w AS zc, y - avg(y) OVER w AS yc, count(*) OVER w AS n FROM rg WINDOW w AS (PARTITION BY key)),
c1 AS (SELECT *, xc - sum(xc * zc) OVER w / sum(zc * zc) OVER w * zc AS xt, zc - sum(xc * zc) OVER w / sum(xc * xc) OVER w * xc AS zt FROM c0 WINDOW w AS (PARTITION BY key)),
c2 AS (SELECT *, sum(xt * yc) OVER w / sum(xt * xt) OVER w AS b, sum(zt * yc) OVER w / sum(zt * zt) OVER w AS c, sum(xt * xt) OVER w AS q FROM c1 WINDOW w AS (PARTITION BY key)),
c3 AS (SELECT key, n, b, t, (yc - b * xc - c * zc) * xt / q AS s FROM c2),
c4 AS (SELECT *, {', '.join(f'lag(s, {k}) OVER w AS s{k}' for k in range(1, LAG + 1))} FROM c3 WINDOW w AS (PARTITION BY key ORDER BY t)),
nw AS (SELECT key, n, b AS slope, sqrt(greatest(0, sum(s * s) + {' + '.join(f'{2 * (1 - k / (LAG + 1)):.17g} * coalesce(sum(s * s{k}), 0)' for k in range(1, LAG + 1))})) AS error FROM c4 GROUP BY key, n, b HAVING n > {LAG + 4}),
tp AS (SELECT *, n - 3 AS dof, atan(abs(slope / error) / sqrt(n - 3)) AS angle FROM nw)"""
P = t_p_sql("angle", "dof")


def with_p(rows, by):
    fit = regress.newey_west(rows, by, "y", ["x", "z"], lag=LAG).where("slope IS NOT NULL")
    return fit.withColumn("p", F.when(F.col("error") > 0, regress.t_two_sided(F.col("slope") / F.col("error"), F.col("n") - 3)))


@query("m3_newey_west", "n", "slope error p", "model", views="s p", ctes="rg AS (SELECT model AS key, s.t, s.v AS y, x, z FROM s JOIN p ON s.t = p.t), " + NEWEY_WEST, sql=f"SELECT key AS model, n, slope, error, {P} AS p FROM tp")
def _(spark, d):
    s = segment_month(spark, d).join(ship_month(spark, d).select("t", "x", "z"), "t").select("model", "t", F.col("v").alias("y"), "x", "z")
    return with_p(s, ["model"])


@query("m6_regression_map", "cell n", "slope error p", views="f p", ctes="rg AS (SELECT cell AS key, p.t, f.v AS y, x, z FROM f JOIN p ON f.t - 5 = p.t), " + NEWEY_WEST, sql=f"SELECT key AS cell, n, slope, error, {P} AS p FROM tp")
def _(spark, d):
    """Each cell's response to a series five months before it."""
    s = nation_month(spark, d).select("cell", (F.col("t") - 5).alias("t"), F.col("v").alias("y")).join(ship_month(spark, d).select("t", "x", "z"), "t")
    return with_p(s, ["cell"])


@query(
    "m4_four_predictors", "cell n", "share b1 b2 b3 b4", views="f p",
    ctes="""j AS (SELECT cell, f.v AS v, a.x AS x1, a.z AS x2, a.y AS x3, b.x AS x4 FROM f JOIN p a ON f.t = a.t JOIN p b ON b.t = a.t - 1),
g2 AS (SELECT *, x2 - covar_pop(x2, x1) OVER w / var_pop(x1) OVER w * x1 AS e2, covar_pop(x2, x1) OVER w / var_pop(x1) OVER w AS c21 FROM j WINDOW w AS (PARTITION BY cell)),
g3 AS (SELECT *, x3 - covar_pop(x3, x1) OVER w / var_pop(x1) OVER w * x1 - covar_pop(x3, e2) OVER w / var_pop(e2) OVER w * e2 AS e3, covar_pop(x3, x1) OVER w / var_pop(x1) OVER w AS c31, covar_pop(x3, e2) OVER w / var_pop(e2) OVER w AS c32 FROM g2 WINDOW w AS (PARTITION BY cell)),
g4 AS (SELECT *, covar_pop(x4, x1) OVER w / var_pop(x1) OVER w AS c41, covar_pop(x4, e2) OVER w / var_pop(e2) OVER w AS c42, covar_pop(x4, e3) OVER w / var_pop(e3) OVER w AS c43 FROM g3 WINDOW w AS (PARTITION BY cell)),
g5 AS (SELECT *, x4 - c41 * x1 - c42 * e2 - c43 * e3 AS e4 FROM g4),
a AS (SELECT cell, count(*) AS n, max(c21) AS c21, max(c31) AS c31, max(c32) AS c32, max(c41) AS c41, max(c42) AS c42, max(c43) AS c43,
  regr_slope(v, x1) AS a1, regr_slope(v, e2) AS a2, regr_slope(v, e3) AS a3, regr_slope(v, e4) AS a4, pow(corr(v, x1), 2) + pow(corr(v, e2), 2) + pow(corr(v, e3), 2) + pow(corr(v, e4), 2) AS share FROM g5 GROUP BY cell HAVING count(*) >= 30),
b AS (SELECT *, a4 AS b4, a3 - c43 * a4 AS b3 FROM a), b2 AS (SELECT *, a2 - c32 * b3 - c42 * a4 AS b2 FROM b)""",
    sql="SELECT cell, n, share, a1 - c21 * b2 - c31 * b3 - c41 * b4 AS b1, b2, b3, b4 FROM b2", places=4,
)
def _(spark, d):
    """Variance of each cell explained by four series together: quantity, discount, price, and quantity a month before; thirty months at least."""
    p = ship_month(spark, d)
    predictors = p.select("t", F.col("x").alias("x1"), F.col("z").alias("x2"), F.col("y").alias("x3")).join(p.select((F.col("t") + 1).alias("t"), F.col("x").alias("x4")), "t")
    rows = nation_month(spark, d).select("cell", "t", "v").join(predictors, "t")
    fit = regress.fitted(rows, ["cell"], "v", ["x1", "x2", "x3", "x4"]).where("n >= 30")
    return fit.select("cell", "n", "share", *[F.element_at("coefficients", i).alias(f"b{i}") for i in (1, 2, 3, 4)])
