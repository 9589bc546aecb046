"""Composite tests: what several operators say together, as one row with a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import kernels, registered
from tesserae.functions.scalar import safe_corr
from tesserae.operators import series, spectral, stats


def correlation_test(spark: SparkSession, x: DataFrame, y: DataFrame, strong: float = 0.6, suggestive: float = 0.3, replicates: int = 200, block: int = 12, period: float = 12.0) -> DataFrame:
    """Two monthly series (t, v) on their common months, low-passed at a year: correlation, its p, its block-bootstrap interval, and a verdict:
    supported if rho is strong with p < 0.01, falsified below the suggestive size, else deferred; deferred too with fewer than 24 common months."""
    both = x.select("t", F.col("v").alias("x")).join(y.select("t", F.col("v").alias("y")), "t").where("x IS NOT NULL AND y IS NOT NULL")
    long = both.select("t", F.explode(F.array(F.struct(F.lit("x").alias("of"), F.col("x").alias("v")), F.struct(F.lit("y").alias("of"), F.col("y").alias("v")))).alias("s")).select("t", "s.of", "s.v")
    slow = spectral.lowpass(long, ["of"], period)
    pair = slow.groupBy("t").agg(F.max(F.when(F.col("of") == "x", F.col("f"))).alias("x"), F.max(F.when(F.col("of") == "y", F.col("f"))).alias("y"))
    indexed = pair.withColumn("i", (F.row_number().over(series.Window.partitionBy(F.lit(1)).orderBy("t")) - 1).cast("long"))  # one series
    r = indexed.agg(F.count("*").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("rho"))
    reps = stats.resampled(spark, indexed, replicates, block).groupBy("replicate").agg(safe_corr(F.col("x"), F.col("y")).alias("c"))
    p = registered.pearson_p(F.col("rho"), F.col("n").cast("double"))
    out = r.withColumn("p", p).crossJoin(stats.interval(reps, "c").select("low", "high"))  # one row beside one
    verdict = F.when((F.col("n") < 24) | F.col("rho").isNull(), "deferred").when(F.col("rho") < suggestive, "falsified").when((F.col("rho") >= strong) & (F.col("p") < 0.01), "supported").otherwise("deferred")
    return out.withColumn("verdict", verdict)


def area_test(coherence: DataFrame, places: DataFrame, incoherent: Column, coherent: Column, low: float = 0.5, high: float = 0.8, least_low: float = 1e6, least_high: float = 3e6, share: float = 0.5) -> DataFrame:
    """Each year's mean coherence of cells: a year passes if the largest patch at most `low` in one box and the largest at least `high` in the other reach their areas;
    supported if enough years pass. coherence: cell, year, r; places: cell, lat_idx, lon_idx, lat, lon, area; the boxes are conditions on places."""
    annual = coherence.groupBy("cell", "year").agg(F.avg("r").alias("r")).join(places, "cell")
    patch = lambda box, hit, name: spectral.largest_patches(annual.where(box & hit), ["year"]).withColumnRenamed("area", name)
    a, b = patch(incoherent, F.col("r") <= low, "low_area"), patch(coherent, F.col("r") >= high, "high_area")
    rows = coherence.select("year").distinct().join(a, "year", "left").join(b, "year", "left")
    passing = F.count_if((F.coalesce("low_area", F.lit(0.0)) >= least_low) & (F.coalesce("high_area", F.lit(0.0)) >= least_high))
    out = rows.agg(F.count("*").alias("years"), passing.alias("passing")).withColumn("share", F.try_divide("passing", "years"))
    return out.withColumn("verdict", F.when(F.col("share") >= share, "supported").otherwise("falsified"))


def lead_time_test(indicators: DataFrame, by: list[str], sigmas: float = 1.0, persist: int = 6, least: int = 24) -> DataFrame:
    """indicators: by, t, v, var, ac1. The warning is the first lasting rise of either indicator above its mean by `sigmas`
    spreads, the event the first lasting fall of v below its mean by as much; supported if the warning leads by at least `least`.
    Of the two indicators' times the earlier that is there counts."""
    w = series.Window.partitionBy(*by)
    level = lambda c, s: F.avg(c).over(w) + s * F.stddev_pop(c).over(w)
    rows = indicators.withColumn("_hv", level("var", sigmas)).withColumn("_ha", level("ac1", sigmas)).withColumn("_lv", level("v", -sigmas / 2))
    cross = lambda c, n: series.first_crossing(rows, by, c, persist).withColumnRenamed("first", n)
    a, b = cross(F.col("var") > F.col("_hv"), "w1"), cross(F.col("ac1") > F.col("_ha"), "w2")
    e = series.first_crossing(rows, by, F.col("v") < F.col("_lv"), 2).withColumnRenamed("first", "event")
    out = a.join(b, by).join(e, by).withColumn("warning", F.least("w1", "w2"))
    lead = F.col("event") - F.col("warning")
    return out.select(*by, "warning", "event", lead.alias("lead"), F.when(lead >= least, "supported").when(lead < least, "falsified").otherwise("deferred").alias("verdict"))


#: Fixed values of the cross-prediction rule: the observed time scale, bounds of q, factors of the time scale, bounds of p, bound of the reduced chi-square.
TAU, Q_SUPPORT, Q_FALSIFY, NEAR, FAR, P_SUPPORT, P_FALSIFY, CHI2 = 144.0, 0.20, 0.10, 3.0, 10.0, 0.01, 0.05, 5.0


def cross_prediction(spark: SparkSession, cells: DataFrame, by: list[str], replicates: int = 1000) -> DataFrame:
    """by, q, p, tau, chi2 and a verdict for each basin. cells: by, block, x (coherence), y (energy or gradient)."""
    p = stats.block_permutation(cells, replicates, by)
    form = {"registered": kernels.FAMILIES["registered"]}
    fits = spectral.closures(cells.select(*by, F.col("y").alias("d"), F.col("x").alias("r")), by, form).select(*by, F.col("params")[0].alias("tau"), "chi2")
    out = p.join(fits, by, "left").withColumn("q", -F.col("rho"))
    ratio = F.when(F.col("tau") > 0, F.col("tau") / TAU).otherwise(float("inf"))
    supported = (F.col("q") >= Q_SUPPORT) & (F.col("p") < P_SUPPORT) & ratio.between(1 / NEAR, NEAR) & (F.col("chi2") <= CHI2)
    falsified = ((F.col("q") < Q_FALSIFY) & (F.col("p") >= P_FALSIFY)) | (ratio > FAR) | (ratio < 1 / FAR) | (F.col("chi2") > CHI2)
    known = F.col("q").isNotNull() & F.col("tau").isNotNull()
    return out.select(*by, "q", "p", "tau", "chi2", F.when(~known, "deferred").when(supported, "supported").when(falsified, "falsified").otherwise("deferred").alias("verdict"))
