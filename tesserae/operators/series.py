"""Operators on time series: rows keyed by a group (cell, model, ...) and an integer time t, with value v."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tesserae.functions.scalar import safe_corr, wrapped


def ordered(by: list[str], t: str = "t") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(t)


def anomaly(field: DataFrame, by: list[str], season: str = "month") -> DataFrame:
    """Adds a: v minus its mean over the same month of all years; missing values are skipped."""
    return field.withColumn("a", F.col("v") - F.avg("v").over(Window.partitionBy(*by, season)))


def complete_only(field: DataFrame, by: list[str], length: int) -> DataFrame:
    """The groups with a value at each of `length` times."""
    return field.withColumn("_n", F.count("v").over(Window.partitionBy(*by))).where(F.col("_n") == length).drop("_n")


def detrend(field: DataFrame, by: list[str], v: str = "v", out: str = "d") -> DataFrame:
    """Adds the residual of least squares on t; null where v is, or where t doesn't vary."""
    w = Window.partitionBy(*by)
    y, x = F.col(v), F.when(F.col(v).isNotNull(), F.col("t").cast("double"))
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    slope = F.try_divide(F.covar_pop(y, x).over(w), F.var_pop(x).over(w))
    return field.withColumn(out, y - my - slope * (x - mx))


def base_anomaly(field: DataFrame, by: list[str], in_base: Column) -> DataFrame:
    """Adds a: v minus its mean over the base rows of its group; minus the median of all with fewer than two of those."""
    w = Window.partitionBy(*by)
    base = F.when(in_base, F.col("v"))
    centre = F.when(F.count(base).over(w) >= 2, F.avg(base).over(w)).otherwise(F.percentile("v", 0.5).over(w))
    return field.withColumn("a", F.col("v") - centre)


def annual(field: DataFrame, by: list[str]) -> DataFrame:
    return field.groupBy(*by, "year").agg(F.avg("v").alias("v"))


def winter(field: DataFrame, by: list[str], by_january: bool = True) -> DataFrame:
    """December to February means. Labelled by January's year they need three months; by December's, any."""
    rows = field.where(F.col("month").isin(12, 1, 2))
    label = F.col("year") + F.when(F.col("month") == 12, 1).otherwise(0) - (0 if by_january else 1)
    out = rows.groupBy(*by, label.alias("season")).agg(F.count("v").alias("n"), F.avg("v").alias("v"))
    return out.where("n >= 3") if by_january else out


def months_mean(field: DataFrame, by: list[str], first: int, last: int) -> DataFrame:
    return field.where(F.col("month").between(first, last)).groupBy(*by, "year").agg(F.avg("v").alias("v"))


def windows(field: DataFrame, by: list[str], width: int, stride: int, start: int, stop: int, share: float = 0.8, per_year: int = 12) -> DataFrame:
    """Sliding windows over years: rows (by, start, centre, n, mean), the mean null with under `share` of all months.

    Each year goes to the width / stride windows that hold it.
    """
    rows = field.groupBy(*by, "year").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    first = F.greatest(F.lit(start), start + F.ceil((F.col("year") - width + 1 - start) / stride).cast("int") * stride)
    last = F.least(F.col("year"), F.lit(stop - width + 1))
    rows = rows.where(first <= last).withColumn("start", F.explode(F.sequence(first.cast("int"), last.cast("int"), F.lit(stride))))
    n = F.sum("n")
    return rows.groupBy(*by, "start").agg(n.alias("n"), F.when(n >= share * width * per_year, F.try_divide(F.sum("s"), n)).alias("mean")).withColumn("centre", F.col("start") + width // 2)


def rolling(field: DataFrame, by: list[str], width: int) -> DataFrame:
    """Adds var (sample) and ac1 (Pearson's of the shifted slices) over the last `width` rows; null before there are so many."""
    o = ordered(by)
    rows = field.withColumn("_p", F.lag("v").over(o)).withColumn("_k", F.row_number().over(o))
    frame, pairs = o.rowsBetween(1 - width, 0), o.rowsBetween(2 - width, 0)
    full = F.col("_k") >= width
    return rows.withColumn("var", F.when(full, F.var_samp("v").over(frame))).withColumn("ac1", F.when(full, safe_corr(F.col("v"), F.col("_p"), pairs))).drop("_p", "_k")


def lag1_products(field: DataFrame, by: list[str], definition: str) -> DataFrame:
    """Lag-1 autocorrelation by one of four definitions: mean of the n - 1 products over the variance; sum over sum; Pearson's of the slices;
    Pearson's of the slices of what is left once missing values are taken out (`present`)."""
    o = ordered(by)
    if definition == "present":
        field = field.where("v IS NOT NULL")
    rows = field.withColumn("_c", F.col("v") - F.avg("v").over(Window.partitionBy(*by))).withColumn("_p", F.lag("_c").over(o)).withColumn("_l", F.lag("v").over(o))
    if definition == "mean":
        e = F.try_divide(F.avg(F.col("_c") * F.col("_p")), F.var_pop("v"))
    elif definition == "sum":
        e = F.try_divide(F.sum(F.col("_c") * F.col("_p")), F.sum(F.col("_c") * F.col("_c")))
    elif definition in ("pearson", "present"):
        e = safe_corr(F.col("v"), F.col("_l"))
    else:
        raise ValueError(f"unknown definition {definition!r}")
    return rows.groupBy(*by).agg(e.alias("ac1"))


def lag_correlation(x: DataFrame, by: list[str], lags: list[int], least: int = 30) -> DataFrame:
    """Pearson's r of x(t) and y(t + lag) for each lag, of pairs that are both there; rows (by, lag, n, r). x: by, t, x, y."""
    shifted = x.select(*by, "t", "x", F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    later = x.select(*by, F.col("t").alias("_t"), F.col("y").alias("_y"))
    pairs = shifted.withColumn("_t", F.col("t") + F.col("lag")).join(later, [*by, "_t"]).where("x IS NOT NULL AND _y IS NOT NULL")
    return pairs.groupBy(*by, "lag").agg(F.count("*").alias("n"), safe_corr(F.col("x"), F.col("_y")).alias("r")).where(F.col("n") >= least)


def central_difference(field: DataFrame, by: list[str]) -> DataFrame:
    """Adds dv: half of next minus previous, one-sided at the ends."""
    o = ordered(by)
    n, p = F.lead("v").over(o), F.lag("v").over(o)
    return field.withColumn("dv", F.coalesce((n - p) / 2, n - F.col("v"), F.col("v") - p))


def first_crossing(field: DataFrame, by: list[str], condition: Column, persist: int, strict: bool = True) -> DataFrame:
    """The first t at which the condition holds for `persist` rows; strict: a run that ends with the series' last row doesn't count."""
    o = ordered(by)
    holds = F.coalesce(condition, F.lit(False)).cast("int")
    last = F.max("_k").over(Window.partitionBy(*by))
    rows = field.withColumn("_k", F.row_number().over(o)).withColumn("_run", F.min(holds).over(o.rowsBetween(0, persist - 1))).withColumn("_last", last)
    ok = (F.col("_run") == 1) & (F.col("_k") + persist - 1 + (1 if strict else 0) <= F.col("_last"))
    return rows.groupBy(*by).agg(F.min(F.when(ok, F.col("t"))).alias("first"))


def strict_exit(field: DataFrame, by: list[str], threshold: Column, margin: Column, persist: int = 3) -> DataFrame:
    """The first t above threshold + margin that stays above the threshold for `persist` rows."""
    o = ordered(by)
    rows = field.withColumn("_run", F.min((F.col("v") > threshold).cast("int")).over(o.rowsBetween(0, persist - 1))).withColumn("_n", F.count("*").over(o.rowsBetween(0, persist - 1)))
    return rows.groupBy(*by).agg(F.min(F.when((F.col("v") > threshold + margin) & (F.col("_run") == 1) & (F.col("_n") == persist), F.col("t"))).alias("exit"))


def overturning(profile: DataFrame, by: list[str]) -> DataFrame:
    """Largest running trapezoid integral of v over depth z."""
    o = Window.partitionBy(*by).orderBy("z")
    step = 0.5 * (F.col("v") + F.lag("v").over(o)) * (F.col("z") - F.lag("z").over(o))
    rows = profile.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("_c", F.sum("_s").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by).agg(F.max("_c").alias("strength"))


def peak(profile: DataFrame, by: list[str], x: str, v: str) -> DataFrame:
    """Place of the maximum between grid points: a parabola through it and its neighbours, shifted one step at most."""
    o = Window.partitionBy(*by).orderBy(x)
    rows = profile.withColumn("_b", F.lag(v).over(o)).withColumn("_a", F.lead(v).over(o)).withColumn("_s", F.coalesce(F.lead(x).over(o) - F.col(x), F.col(x) - F.lag(x).over(o)))
    top = rows.groupBy(*by).agg(F.max_by(F.struct(F.col(x).alias("x"), F.col(v).alias("v"), "_b", "_a", "_s"), F.struct(v, -F.col(x))).alias("m"))
    bend = F.col("m._b") - 2 * F.col("m.v") + F.col("m._a")
    shift = F.when(bend != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (F.col("m._b") - F.col("m._a")) / bend))).otherwise(0.0)
    return top.select(*by, (F.col("m.x") + shift * F.coalesce("m._s", F.lit(0.0))).alias("at"), F.col("m.v").alias("top"))


def lanczos_weights(n: int, low: float, high: float) -> list[float]:
    """Band-pass weights (2 n + 1) for frequencies per step between low and high, with sigma factors."""
    out = []
    for k in range(-n, n + 1):
        if k == 0:
            out.append(2 * (high - low))
        else:
            sigma = math.sin(math.pi * k / n) / (math.pi * k / n)
            out.append((math.sin(2 * math.pi * high * k) - math.sin(2 * math.pi * low * k)) / (math.pi * k) * sigma)
    return out


def weighted_frame(field: DataFrame, by: list[str], weights: list[float], out: str = "f") -> DataFrame:
    """Adds the weighted sum over the rows around each; null near the ends and where one is missing."""
    o, n = ordered(by), len(weights) // 2
    terms = [F.lit(w) * (F.lag("v", n - i).over(o) if i < n else F.lead("v", i - n).over(o) if i > n else F.col("v")) for i, w in enumerate(weights)]
    return field.withColumn(out, sum(terms[1:], terms[0]))


def gaussian_weights(sigma: float, reach: float = 4.0) -> list[float]:
    n = int(reach * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-n, n + 1)]
    return [x / sum(w) for x in w]


def frequency(phases: DataFrame, by: list[str], per_unit: float = 1.0) -> DataFrame:
    """Mean instantaneous frequency: wrapped phase steps over two pi (the gradient of the unwrapped phase, averaged)."""
    o = ordered(by)
    rows = phases.withColumn("_d", wrapped(F.col("phase") - F.lag("phase").over(o))).withColumn("_u", F.sum(F.coalesce("_d", F.lit(0.0))).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    n, p = F.lead("_u").over(o), F.lag("_u").over(o)
    rows = rows.withColumn("_g", F.coalesce((n - p) / 2, n - F.col("_u"), F.col("_u") - p))
    return rows.groupBy(*by).agg((F.avg("_g") * per_unit / (2 * math.pi)).alias("omega"))


def binary_transfer_entropy(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Bits that the source's sign (above its median) tells of the target's next sign beyond its own. pairs: by, t, target, source."""
    w, o = Window.partitionBy(*by), ordered(by)
    sign = lambda c: (F.col(c) > F.percentile(c, 0.5).over(w)).cast("int")
    rows = pairs.withColumn("b", sign("target")).withColumn("c", sign("source")).withColumn("a", F.lead("b").over(o)).where("a IS NOT NULL")
    n = rows.groupBy(*by, "a", "b", "c").agg(F.count("*").cast("double").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy(*by, *k))
    n = n.select(*by, "n", over().alias("all"), over("b", "c").alias("bc"), over("a", "b").alias("ab"), over("b").alias("b_"))
    return n.groupBy(*by).agg(F.sum(F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("b_") / (F.col("bc") * F.col("ab")))).alias("bits"))


def drift(field: DataFrame, by: list[str], per_year: int = 12) -> DataFrame:
    """Size of the linear trend of v per year."""
    return field.groupBy(*by).agg((F.abs(F.regr_slope("v", F.col("t").cast("double"))) * per_year).alias("drift"))


def interpolated(samples: DataFrame, by: list[str], step: int, first: int, last: int) -> DataFrame:
    """v on a regular grid of ages between neighbouring samples, none beyond them; of equal ages the first by value stays.

    Each pair of neighbouring samples makes the grid points that lie between them. samples: by, age, v.
    """
    one = samples.where("age IS NOT NULL AND v IS NOT NULL").groupBy(*by, "age").agg(F.min("v").alias("v"))
    o = Window.partitionBy(*by).orderBy("age")
    pairs = one.withColumn("na", F.lead("age").over(o)).withColumn("nv", F.lead("v").over(o)).withColumn("final", F.lead("age", 2).over(o).isNull())
    low = F.greatest(F.lit(first), first + F.ceil((F.col("age") - first) / step) * step).cast("int")
    high = F.least(F.lit(last), first + F.floor((F.col("na") - first) / step) * step).cast("int")
    rows = pairs.where(F.col("na").isNotNull() & (low <= high)).withColumn("at", F.explode(F.sequence(low, high, F.lit(step))))
    rows = rows.where((F.col("at") < F.col("na")) | F.col("final"))
    return rows.select(*by, "at", (F.col("v") + (F.col("nv") - F.col("v")) * (F.col("at") - F.col("age")) / (F.col("na") - F.col("age"))).alias("v"))


def stack(samples: DataFrame, by: list[str], step: int, first: int, last: int, least: int = 3) -> DataFrame:
    """The mean over cores on the regular grid, where at least `least` cores reach."""
    return interpolated(samples, by, step, first, last).groupBy("at").agg(F.count("*").alias("n"), F.avg("v").alias("v")).where(F.col("n") >= least)


def nearest_time(left: DataFrame, right: DataFrame, by: list[str], tolerance: int) -> DataFrame:
    """As-of join: adds v and dt of the right row nearest in time within the tolerance, ties to the earlier; null without one.

    Times meet in buckets as wide as the tolerance. left: by, t (distinct); right: by, t, v.
    """
    b = F.floor(F.col("t") / tolerance)
    near = left.select(*by, "t", F.explode(F.array(b - 1, b, b + 1)).alias("_b")).join(right.select(*by, F.col("t").alias("_t"), "v", b.alias("_b")), [*by, "_b"])
    best = near.where(F.abs(F.col("t") - F.col("_t")) <= tolerance).groupBy(*by, "t").agg(F.min(F.struct(F.abs(F.col("t") - F.col("_t")).alias("d"), F.col("_t").alias("at"), "v")).alias("m"))
    return left.join(best, [*by, "t"], "left").select(*[left[c] for c in left.columns], F.col("m.at").alias("at"), F.col("m.v").alias("v"))
