"""Least squares on any number of predictors as aggregates: moments, a sweep over an array, and lagged products.

Each group's centred second moments of predictors and y are one row. Sweeping their matrix at each predictor (a row operation on a flat array,
by array functions) turns it into coefficients, the inverse of the predictors' moments, and what is left of y's. A predictor that the ones before it
explain is left out, so that shares of variance are those of the others. No group's rows are gathered, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is left of a predictor's variance, as a share, below which the ones before it explain it.
LEAST = 1e-10


def sweep(matrix: Column, k: int) -> Column:
    """A flat symmetric matrix of side k + 1 swept at its first k places: inverse of the first block, coefficients in the last column, and the residual moment in the last place."""
    side = k + 1

    def at(i: Column, a: Column) -> Column:
        pivot = F.element_at(a, i * side + i + 1)
        own = F.element_at(matrix, i * side + i + 1)

        def cell(v: Column, p: Column) -> Column:
            r, c = F.floor(p / side).cast("int"), (p % side).cast("int")
            of_row, of_column = F.element_at(a, i * side + c + 1), F.element_at(a, r * side + i + 1)
            return F.when((r == i) & (c == i), -1 / pivot).when(r == i, of_row / pivot).when(c == i, of_column / pivot).otherwise(v - of_row * of_column / pivot)

        return F.when(pivot > LEAST * own, F.transform(a, cell)).otherwise(a)

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), matrix, lambda a, i: at(i, a))


def fitted(rows: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """by, n, mean_y, means, total (y's moment), left (its residual), share (R^2), coefficients (in order of xs), inverse (of the predictors' moments, flat; places left out are 0).

    Rows with a missing value in y or any predictor don't count. A group without variance of y has no share.
    """
    names, k = [*xs, y], len(xs)
    known = rows.dropna(subset=names)
    moments = F.array(*[F.covar_pop(*sorted((a, b))) * F.count("*") for a in names for b in names])
    means = F.array(*[F.avg(x).cast("double") for x in xs])
    m = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(y).alias("mean_y"), means.alias("means"), moments.alias("_m"))
    m = m.withColumn("_s", sweep(F.col("_m"), k))
    side = k + 1
    # An element of the diagonal is negative once its predictor has been swept.
    inside = lambda i: F.element_at("_s", i * side + i + 1) < 0
    coefficient = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(inside(i), F.element_at("_s", i * side + k + 1)).otherwise(0.0))
    inverse = F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), lambda p: F.when(inside(F.floor(p / k).cast("int")) & inside((p % k).cast("int")), -F.element_at("_s", F.floor(p / k).cast("int") * side + (p % k).cast("int") + 1)).otherwise(0.0))
    total, left = F.element_at("_m", side * side), F.greatest(F.lit(0.0), F.element_at("_s", side * side))
    out = m.select(*by, "n", "mean_y", "means", total.alias("total"), left.alias("left"), coefficient.alias("coefficients"), inverse.alias("inverse"))
    return out.withColumn("share", F.when(F.col("total") > 0, 1 - F.col("left") / F.col("total")))


def newey_west(rows: DataFrame, by: list[str], y: str, xs: list[str], t: str = "t", lag: int = 4, least: int = 0) -> DataFrame:
    """by, n, slope of y on the first of xs beside the others, error: its standard error with Bartlett weights up to `lag` rows; groups of at most lag + len(xs) + 2 or fewer than `least` rows have nulls.

    The variance of a coefficient is that of a weighted sum of residuals, so its lagged products are sums of one number a row.
    """
    known = rows.dropna(subset=[y, *xs])
    fit = fitted(known, by, y, xs)
    k = len(xs)
    joined = known.select(*by, t, y, *xs).join(fit.select(*by, "n", "mean_y", "means", "coefficients", "inverse"), by)
    off = [F.col(x) - F.element_at("means", i + 1) for i, x in enumerate(xs)]
    residual = F.col(y) - F.col("mean_y") - sum(F.element_at("coefficients", i + 1) * o for i, o in enumerate(off))
    part = residual * sum(F.element_at("inverse", i + 1) * o for i, o in enumerate(off))
    each = joined.select(*by, t, part.alias("_s"))
    order = Window.partitionBy(*by).orderBy(t)
    products = each.select(*by, "_s", *[F.lag("_s", i).over(order).alias(f"_{i}") for i in range(1, lag + 1)])
    variance = F.sum(F.col("_s") * F.col("_s")) + sum(2 * (1 - i / (lag + 1)) * F.coalesce(F.sum(F.col("_s") * F.col(f"_{i}")), F.lit(0.0)) for i in range(1, lag + 1))
    error = products.groupBy(*by).agg(F.sqrt(F.greatest(F.lit(0.0), variance)).alias("error"))
    enough = (F.col("n") > lag + k + 2) & (F.col("n") >= least)
    return fit.join(error, by).select(*by, "n", F.when(enough, F.element_at("coefficients", 1)).alias("slope"), F.when(enough, F.col("error")).alias("error"))


def t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t with a whole number of degrees of freedom, by the finite sum of powers of the cosine; null for fewer than one."""
    angle = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    c2 = F.pow(F.cos(angle), 2)
    odd = dof % 2 == 1
    steps = F.when(dof >= F.when(odd, 3).otherwise(2), F.sequence(F.lit(1), F.floor((dof - F.when(odd, 1).otherwise(0)) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    # Terms behind the first: each is the one before by c2 (2i - 1) / (2i) for even, by c2 (2i) / (2i + 1) for odd degrees; the last place only counts the terms.
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term"))
    ratio = lambda i: F.when(odd, 2 * i / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))
    total = F.aggregate(steps, start, lambda s, i: F.struct((s["total"] + s["term"]).alias("total"), (s["term"] * c2 * ratio(i)).alias("term")))["total"]
    inside = F.when(odd, 2 / 3.141592653589793 * (angle + F.sin(angle) * F.cos(angle) * total)).otherwise(F.sin(angle) * total)
    return F.when((dof >= 1) & t.isNotNull(), F.greatest(F.lit(0.0), 1 - inside))
