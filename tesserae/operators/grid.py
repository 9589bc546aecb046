"""Operators on gridded fields: long tables (cell, lat_idx, lon_idx, lat, lon, ..., v).

Neighbours within a radius come from a join on latitude bands and longitude cells with an exact
great-circle residual: each place is sent to the few cells around it, never to all others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalar import EARTH_KM, coriolis, haversine_km, safe_corr, wrapped

KM_PER_DEGREE = math.pi * EARTH_KM / 180
G = 9.81
#: Cells of a position in one block at most; a position with more has several blocks.
BLOCK = 1024
#: Cells of a block that are paired at once.
FEW = 32


def regrid(field: DataFrame, by: list[str], south: float, west: float, step: float, rows: int, columns: int, least: int = 4, weighted: bool = True) -> DataFrame:
    """Box means on a regular grid, weighted by the cosine of latitude; boxes with fewer than `least` values are null.

    Boxes are half-open but the last ones, which hold their far edge. Places outside are dropped.
    """
    i, j = F.floor((F.col("lat") - south) / step), F.floor((F.col("lon") - west) / step)
    inside = F.col("lat").between(south, south + rows * step) & F.col("lon").between(west, west + columns * step)
    w = F.cos(F.radians("lat")) if weighted else F.lit(1.0)
    boxes = field.where(inside).withColumn("i", F.least(i, F.lit(rows - 1)).cast("int")).withColumn("j", F.least(j, F.lit(columns - 1)).cast("int"))
    n = F.count("v")
    mean = F.sum(w * F.col("v")) / F.sum(F.when(F.col("v").isNotNull(), w))
    return boxes.groupBy(*by, F.col("i").alias("lat_idx"), F.col("j").alias("lon_idx")).agg(n.alias("n"), F.when(n >= least, mean).alias("v"))


def box_mean(field: DataFrame, by: list[str], box: Column | None = None) -> DataFrame:
    """Cosine-weighted mean over a region; missing cells lose their weight."""
    w = F.cos(F.radians("lat"))
    rows = field.where(box) if box is not None else field
    return rows.groupBy(*by).agg((F.sum(w * F.col("v")) / F.sum(F.when(F.col("v").isNotNull(), w))).alias("v"))


def pieces(array: str, size: int) -> Column:
    """A filled array cut into arrays of at most `size` values."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / size).cast("int")), lambda i: F.slice(array, i * size + 1, F.lit(size)))


def neighbours(places: DataFrame, km: float, self_too: bool = True, digits: int | None = None) -> DataFrame:
    """cell, nbr, km for all pairs of places within the distance, each place with itself if asked for; km is rounded if `digits` are given.

    places: cell (never null), lat, lon. Cells of one position share its distances: they meet in blocks, a distance is worked out for two
    blocks, and pairs of their cells are made last. Within `km` two places differ by at most one latitude band; the longitude cell of a
    band is as wide as the distance at the band's poleward neighbours, so they differ by at most one of those too.
    """
    degrees = km / KM_PER_DEGREE * 1.0001
    band = F.floor((F.col("lat") + 90) / degrees).cast("int")

    def width(b: Column) -> Column:
        """Longitude cells in a band: none narrower than the distance at the latitudes within one band of it."""
        pole = F.least(F.greatest(F.abs((b - 1) * degrees - 90), F.abs((b + 2) * degrees - 90)), F.lit(90.0))
        ratio = F.sin(F.radians(F.lit(min(degrees, 180.0) / 2))) / F.greatest(F.cos(F.radians(pole)), F.lit(1e-9))
        return F.when((ratio >= 0.5) | (pole >= 89.0), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 / F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) / 1.0001))).cast("int")

    def place(n: Column) -> Column:
        return F.floor(F.pmod(F.col("lon"), F.lit(360.0)) / 360 * n).cast("int")

    cells = F.sort_array(F.collect_list("cell"))  # sorted: a task that runs again makes the same blocks
    p = places.groupBy("lat", "lon").agg(cells.alias("all")).withColumn("band", band)
    p = p.where(F.size("all") > 0).select("lat", "lon", "band", F.posexplode(pieces("all", BLOCK)).alias("part", "cells"))
    spread = p.select("cells", "lat", "lon", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("at"))
    n = width(F.col("at"))
    spread = spread.withColumn("n", n).withColumn("x", place(n))
    spread = spread.select("cells", "lat", "lon", "at", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("x") + d, F.col("n"))))).alias("slot"))
    # Each block of a crowd, a position of several, is a key of its own, and what lies around is sent to all of them. Crowds are fewer than one in BLOCK of the places.
    crowds = places.groupBy("lat", "lon").agg(F.ceil(F.count("cell") / BLOCK).cast("int").alias("parts")).where("parts > 1")
    deals = crowds.select("parts", band.alias("at"), place(width(band)).alias("slot")).groupBy("at", "slot").agg(F.max("parts").alias("deals"))
    spread = spread.join(F.broadcast(deals), ["at", "slot"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("deals"), F.lit(1)) - 1)))
    other = p.select(F.col("cells").alias("nbrs"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon"), F.col("band").alias("at"), place(width(F.col("band"))).alias("slot"), "part")
    # The few bytes of the blocks say nothing about the pairs they make: tasks are as many as asked for, not as the bytes ask for.
    spark = places.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = ["at", "slot", "part"]
    d = haversine_km(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon"))
    near = spread.repartition(tasks, *keys).join(other.repartition(tasks, *keys), keys).select("cells", "nbrs", d.alias("km")).where(F.col("km") <= km)
    if digits is not None:
        near = near.withColumn("km", F.round("km", digits))
    few = near.select(F.explode(pieces("cells", FEW)).alias("few"), "nbrs", "km")  # Spark holds all pairs that it makes of a row at once
    pairs = few.select(F.explode("few").alias("cell"), "nbrs", "km").select("cell", F.explode("nbrs").alias("nbr"), "km")
    return pairs if self_too else pairs.where("cell <> nbr")


def nearest(places: DataFrame, k: int, km: float) -> DataFrame:
    """The k nearest other places within km of each, ties by number: cell, nbr, km, rank."""
    order = Window.partitionBy("cell").orderBy("km", "nbr")
    return neighbours(places, km, self_too=False).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sample_at(targets: DataFrame, axis: DataFrame, key: str, value: str, step: float) -> DataFrame:
    """Each target's nearest axis point (independently of the other axis): a join on buckets a step wide and their neighbours.

    targets: key, x; axis: value, x, points at most a step apart. Ties go to the smaller value.
    """
    b = F.floor(F.col("x") / step)
    t = targets.select(key, F.col("x").alias("tx"), F.explode(F.array(b - 1, b, b + 1)).alias("b"))
    a = axis.select(value, F.col("x").alias("ax"), b.alias("b"))
    return t.join(a, "b").groupBy(key).agg(F.min(F.struct(F.abs(F.col("tx") - F.col("ax")).alias("d"), F.col(value))).alias("m")).select(key, f"m.{value}", F.col("m.d").alias("distance"))


def along(axis: str, by: list[str]):
    """A window along one axis of the grid: 'lat' or 'lon'."""
    return Window.partitionBy(*by, "lon_idx" if axis == "lat" else "lat_idx").orderBy("lat_idx" if axis == "lat" else "lon_idx")


def derivative(v: Column, x: Column, over) -> Column:
    """Central differences inside, one-sided at the ends."""
    ahead, behind, xa, xb = F.lead(v).over(over), F.lag(v).over(over), F.lead(x).over(over), F.lag(x).over(over)
    rows_ahead, rows_behind = xa.isNotNull(), xb.isNotNull()
    return F.when(rows_ahead & rows_behind, (ahead - behind) / (xa - xb)).when(rows_ahead, (ahead - v) / (xa - x)).when(rows_behind, (v - behind) / (x - xb))


def gradient(field: DataFrame, by: list[str] = ()) -> DataFrame:
    """Adds gx, gy (per degree) and grad, their Euclidean norm."""
    by = list(by)
    out = field.withColumn("gy", derivative(F.col("v"), F.col("lat"), along("lat", by))).withColumn("gx", derivative(F.col("v"), F.col("lon"), along("lon", by)))
    return out.withColumn("grad", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def eddy_energy(height: DataFrame, edges_zero: bool = True) -> DataFrame:
    """Mean geostrophic eddy kinetic energy of each cell from height anomalies: half the mean square of both velocities.

    Velocities use central differences in metres. On an edge the velocity across it is 0 (edges_zero) or missing.
    Latitudes below 15 degrees are dropped. height: cell, lat_idx, lon_idx, lat, lon, t, v.
    """
    h = height.withColumn("a", F.col("v") - F.avg("v").over(Window.partitionBy("cell")))
    metres = KM_PER_DEGREE * 1000
    north, east = along("lat", ["t"]), along("lon", ["t"])
    f = coriolis(F.col("lat"))
    edge = F.lit(0.0 if edges_zero else None).cast("double")
    inner = lambda c, w: F.lead(c).over(w).isNotNull() & F.lag(c).over(w).isNotNull()
    dy = (F.lead("a").over(north) - F.lag("a").over(north)) / ((F.lead("lat").over(north) - F.lag("lat").over(north)) * metres)
    dx = (F.lead("a").over(east) - F.lag("a").over(east)) / ((F.lead("lon").over(east) - F.lag("lon").over(east)) * metres * F.cos(F.radians("lat")))
    uv = h.withColumn("u", F.when(inner("lat", north), -G / f * dy).otherwise(edge)).withColumn("w", F.when(inner("lon", east), G / f * dx).otherwise(edge))
    return uv.where(F.abs("lat") >= 15).groupBy("cell", "lat_idx", "lon_idx", "lat", "lon").agg(F.avg(0.5 * (F.col("u") * F.col("u") + F.col("w") * F.col("w"))).alias("eke"))


def curl(stress: DataFrame, by: list[str]) -> DataFrame:
    """Adds magnitude and curl (per metre) of a vector field tx, ty."""
    metres = KM_PER_DEGREE * 1000
    dydx = derivative(F.col("ty"), F.col("lon"), along("lon", by)) / (metres * F.cos(F.radians("lat")))
    dxdy = derivative(F.col("tx"), F.col("lat"), along("lat", by)) / metres
    return stress.withColumn("magnitude", F.hypot("tx", "ty")).withColumn("curl", dydx - dxdy)


def trend_map(field: DataFrame, share: float = 0.75) -> DataFrame:
    """Trend per century of each cell with more than `share` of all months present.

    The regressor is centred on the mean of all months, not of the cell's own: equal to least squares only where none is missing.
    """
    x = F.col("year") + (F.col("month") - 0.5) / 12
    months = field.groupBy("year", "month").agg(F.count("*").alias("_")).agg(F.avg(x).alias("mx"), F.count("*").alias("months"))
    rows = field.crossJoin(F.broadcast(months)).withColumn("dx", x - F.col("mx"))  # one row beside each
    mean = F.avg("v").over(Window.partitionBy("cell"))
    rows = rows.withColumn("dv", F.col("v") - mean)
    out = rows.groupBy("cell").agg((F.sum(F.col("dx") * F.col("dv")) / F.sum(F.when(F.col("v").isNotNull(), F.col("dx") * F.col("dx"))) * 100).alias("trend"), (F.count("v") / F.max("months")).alias("present"))
    return out.where(F.col("present") > share)


def bilinear(field: DataFrame, targets: DataFrame, south: float, west: float, step: float) -> DataFrame:
    """Values at targets (id, lat, lon) between the four corners of a regular grid (lat_idx, lon_idx, v); null where a corner is missing."""
    y, x = (F.col("lat") - south) / step, (F.col("lon") - west) / step
    t = targets.select("id", F.floor(y).alias("i"), F.floor(x).alias("j"), (y - F.floor(y)).alias("fy"), (x - F.floor(x)).alias("fx"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("c")
    t = t.select("*", corner).select("id", (F.col("i") + F.col("c.a")).cast("int").alias("lat_idx"), (F.col("j") + F.col("c.b")).cast("int").alias("lon_idx"), (F.when(F.col("c.a") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("c.b") == 1, F.col("fx")).otherwise(1 - F.col("fx"))).alias("w"))
    t = t.where("w > 0").join(field.select("lat_idx", "lon_idx", "v"), ["lat_idx", "lon_idx"], "left")
    return t.groupBy("id").agg(F.when(F.count("v") == F.count("*"), F.sum(F.col("w") * F.col("v"))).alias("v"))


def morans_i(field: DataFrame, k: int, km: float) -> DataFrame:
    """Moran's I over k-nearest-neighbour, row-normalised weights, and the effective sample size n (1 - I) / (1 + I)."""
    mean = field.agg(F.avg("v").alias("m"))
    z = field.where("v IS NOT NULL").crossJoin(F.broadcast(mean)).select("cell", "lat", "lon", (F.col("v") - F.col("m")).alias("z"))
    near = nearest(z, k, km).join(z.select(F.col("cell").alias("nbr"), F.col("z").alias("zn")), "nbr").groupBy("cell").agg(F.avg("zn").alias("lag"))
    out = z.join(near, "cell", "left").agg(F.count("*").alias("n"), (F.sum(F.col("z") * F.coalesce("lag", F.lit(0.0))) / F.sum(F.col("z") * F.col("z"))).alias("moran"))
    return out.withColumn("n_eff", F.col("n") * (1 - F.col("moran")) / (1 + F.col("moran")))


def order_parameter(phases: DataFrame, by: list[str]) -> DataFrame:
    """R and mean angle of the unit vectors of phase, with their number; null without any."""
    c, s = F.avg(F.cos("phase")), F.avg(F.sin("phase"))
    return phases.groupBy(*by).agg(F.count("phase").alias("n"), F.sqrt(c * c + s * s).alias("r"), F.atan2(s, c).alias("angle"))


def local_coherence(phases: DataFrame, near: DataFrame, least: int = 4) -> DataFrame:
    """cell, t, r: the resultant of the phases around each cell; null with fewer than `least` of them. phases: cell, t, phase; near: cell, nbr."""
    around = near.join(phases.select(F.col("cell").alias("nbr"), "t", "phase"), "nbr")
    out = order_parameter(around, ["cell", "t"])
    return out.select("cell", "t", F.when(F.col("n") >= least, F.col("r")).alias("r"))


def local_dispersion(values: DataFrame, near: DataFrame, least: int = 4) -> DataFrame:
    """Population spread of v within the radius of each cell."""
    return near.join(values.select(F.col("cell").alias("nbr"), "v"), "nbr").groupBy("cell").agg(F.count("v").alias("n"), F.stddev_pop("v").alias("spread")).where(F.col("n") >= least)


def square_coherence(phases: DataFrame, rows: int, columns: int, reach: int = 1) -> DataFrame:
    """Coherence over a square window of a periodic grid: each phase is sent to the cells around it."""
    d = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)])
    sent = phases.select("t", "lat_idx", "lon_idx", "phase", F.explode(d).alias("d")).select("t", F.pmod(F.col("lat_idx") + F.col("d.a"), F.lit(rows)).alias("lat_idx"), F.pmod(F.col("lon_idx") + F.col("d.b"), F.lit(columns)).alias("lon_idx"), "phase")
    return order_parameter(sent, ["t", "lat_idx", "lon_idx"])


def winding(phases: DataFrame, by: list[str] = ("t",)) -> DataFrame:
    """Winding number of each plaquette, by its south-west corner: wrapped differences SW, SE, NE, NW, SW over two pi; null with a corner missing."""
    e = Window.partitionBy(*by, "lat_idx").orderBy("lon_idx")
    n = Window.partitionBy(*by, "lon_idx").orderBy("lat_idx")
    east = lambda c: F.when(F.lead("lon_idx").over(e) == F.col("lon_idx") + 1, F.lead(c).over(e))
    rows = phases.withColumn("se", east("phase"))
    north = lambda c: F.when(F.lead("lat_idx").over(n) == F.col("lat_idx") + 1, F.lead(c).over(n))
    rows = rows.withColumn("nw", north("phase")).withColumn("ne", north("se"))
    turn = wrapped(F.col("se") - F.col("phase")) + wrapped(F.col("ne") - F.col("se")) + wrapped(F.col("nw") - F.col("ne")) + wrapped(F.col("phase") - F.col("nw"))
    return rows.withColumn("winding", turn / (2 * math.pi)).drop("se", "nw", "ne")


def defect_density(plaquettes: DataFrame, near: DataFrame, least: int = 4) -> DataFrame:
    """Share of the plaquettes around each cell that hold a defect (winding of at least a half), averaged over time. near: cell, nbr (a plaquette's cell)."""
    rows = near.join(plaquettes.select(F.col("cell").alias("nbr"), "t", "winding"), "nbr").where("winding IS NOT NULL")
    per = rows.groupBy("cell", "t").agg(F.count("*").alias("n"), F.avg((F.abs("winding") >= 0.5).cast("double")).alias("d")).where(F.col("n") >= least)
    return per.groupBy("cell").agg(F.avg("d").alias("density"))


def tile_condition(values: DataFrame, degrees: float = 10.0, least: int = 12) -> DataFrame:
    """Condition number of the normal matrix of [1, g] in each tile, from its sums: the ratio of the two eigenvalues."""
    n, s, q = F.count("v").cast("double"), F.sum("v"), F.sum(F.col("v") * F.col("v"))
    out = values.groupBy(F.floor(F.col("lat") / degrees).cast("int").alias("ti"), F.floor(F.col("lon") / degrees).cast("int").alias("tj")).agg(F.count("v").alias("n"), n.alias("a"), s.alias("b"), q.alias("d")).where(F.col("n") >= least)
    half, root = (F.col("a") + F.col("d")) / 2, F.sqrt(F.pow((F.col("a") - F.col("d")) / 2, 2) + F.col("b") * F.col("b"))
    return out.select("ti", "tj", "n", F.when(half > root, (half + root) / (half - root)).alias("kappa"))


def degree(series: DataFrame, threshold: float = 0.5, cells_a_part: int = 2_000) -> DataFrame:
    """cell, degree: how many other cells' series correlate beyond the threshold over the times that both have (at least three), in blocks of cells held beside each other.

    series: cell, values (arrays of one length, null where a value is missing). Cells are dealt to parts of about cells_a_part; each pair
    of parts is one task's matrix products, so a cell is sent to as many tasks as there are parts and no pair becomes a row.
    """
    import numpy as np
    import pandas as pd

    parts = -(-series.count() // cells_a_part) or 1
    part = F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int")
    dealt = series.select("cell", "values", part.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q"))

    def arrays(values):
        x = np.array([[np.nan if v is None else v for v in row] for row in values], float)
        there = np.isfinite(x)
        middle = np.nanmean(np.where(there, x, np.nan), 1, keepdims=True) if x.size else x
        return np.where(there, x - middle, 0.0), there.astype(float)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        mine, yours = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if mine.empty or yours.empty:
            return pd.DataFrame({"cell": [], "degree": []}).astype({"cell": "int64", "degree": "int64"})
        (x, a), (y, b) = arrays(mine["values"]), arrays(yours["values"])
        n = a @ b.T
        with np.errstate(all="ignore"):
            sx, sy = x @ b.T, a @ y.T
            vx, vy = (x * x) @ b.T - sx * sx / n, a @ (y * y).T - sy * sy / n
            r = (x @ y.T - sx * sy / n) / np.sqrt(vx * vy)
        hit = (n >= 3) & (vx > 1e-12) & (vy > 1e-12) & (np.abs(r) > threshold) & (mine["cell"].to_numpy()[:, None] != yours["cell"].to_numpy()[None])
        return pd.DataFrame({"cell": mine["cell"].to_numpy(), "degree": hit.sum(1)})

    left = dealt.select("cell", "values", F.col("p").alias("i"), F.col("q").alias("j"), F.lit(0).alias("side"))
    right = dealt.select("cell", "values", F.col("q").alias("i"), F.col("p").alias("j"), F.lit(1).alias("side"))
    counts = left.unionByName(right).groupBy("i", "j").applyInPandas(block, "cell long, degree long")
    return counts.groupBy("cell").agg(F.sum("degree").alias("degree"))


def quiescence(coherence: DataFrame, gradients: DataFrame, by: list[str] = (), least: int = 4) -> DataFrame:
    """q = -corr(mean local coherence, gradient) over cells. coherence: cell, r (and by); gradients: cell, grad (and by)."""
    both = coherence.join(gradients, ["cell", *by])
    return both.groupBy(*by).agg(F.count(F.when(F.col("r").isNotNull() & F.col("grad").isNotNull(), 1)).alias("n"), (-safe_corr(F.col("r"), F.col("grad"))).alias("q")).where(F.col("n") >= least)
