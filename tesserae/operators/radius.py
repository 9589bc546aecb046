"""Sums within a great-circle radius by running sums along latitude rows.

On a field whose places lie on rows of equal latitude, the places of one row within a distance of a cell are an interval of
longitudes. The running sum of the row at the interval's last place less that before its first is the row's part. So a cell needs two rows of
running sums for each latitude row in reach and time, however many places lie between them, and no pair of places is made. Rows may be
ragged, with any longitudes; an interval over the date line is two.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.scalar import EARTH_KM

KM_PER_DEGREE = math.pi * EARTH_KM / 180
#: Degrees by which an interval is widened, for places that lie on the circle itself up to rounding.
EDGE = 1e-9


def intervals(places: DataFrame, km: float) -> DataFrame:
    """cell, row (latitude), lo, hi (longitudes in 0 to 360) of the one or two intervals of each latitude row within the distance of each cell. places: cell, lat, lon."""
    degrees = km / KM_PER_DEGREE * 1.0001
    band = lambda c: F.floor((c + 90) / degrees).cast("int")
    at = band(F.col("lat"))
    cells = places.select("cell", "lat", F.pmod(F.col("lon"), F.lit(360.0)).alias("lon"), F.explode(F.array(at - 1, at, at + 1)).alias("band"))
    rows = places.select(F.col("lat").alias("row"), at.alias("band")).distinct()
    left = math.sin(min(km / EARTH_KM, math.pi) / 2) ** 2 - F.pow(F.sin(F.radians(F.col("row") - F.col("lat")) / 2), 2)
    narrow = F.cos(F.radians("lat")) * F.cos(F.radians("row"))
    share = F.when(narrow > 1e-12, left / narrow).otherwise(F.when(left >= -1e-15, 1.0).otherwise(-1.0))
    near = cells.join(rows, "band").withColumn("share", share).where("share >= -1e-15")
    reach = F.degrees(2 * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("share")))))) + EDGE
    near = near.withColumn("lo", F.col("lon") - reach).withColumn("hi", F.col("lon") + reach).withColumn("all", F.col("share") >= 1)
    part = lambda a, b: F.struct(a.cast("double").alias("lo"), b.cast("double").alias("hi"))
    zero, turn = F.lit(0.0), F.lit(360.0)
    parts = (
        F.when(F.col("all"), F.array(part(zero, turn)))
        .when(F.col("lo") < 0, F.array(part(F.col("lo") + 360, turn), part(zero, F.col("hi"))))
        .when(F.col("hi") >= 360, F.array(part(F.col("lo"), turn), part(zero, F.col("hi") - 360)))
        .otherwise(F.array(part(F.col("lo"), F.col("hi"))))
    )
    return near.select("cell", "row", F.explode(parts).alias("p")).select("cell", "row", "p.lo", "p.hi")


def positions(places: DataFrame) -> DataFrame:
    """cell, row, k: a cell's number, from 1, along its latitude row."""
    order = Window.partitionBy("lat").orderBy(F.pmod(F.col("lon"), F.lit(360.0)), "cell")
    return places.select("cell", F.col("lat").alias("row"), F.row_number().over(order).alias("k"))


def ends(places: DataFrame, km: float) -> DataFrame:
    """cell, row, k, sign: a row's part within the distance of a cell is the sum over its ends of sign times the row's running sum at place k."""
    parts = intervals(places, km)
    # Along a row, in order of longitude: interval begins before places, ends behind them.
    own = places.select(F.lit(None).cast(places.schema["cell"].dataType).alias("cell"), F.col("lat").alias("row"), F.pmod(F.col("lon"), F.lit(360.0)).alias("x"), F.lit(0).alias("sign"))
    begins = parts.select("cell", "row", F.col("lo").alias("x"), F.lit(-1).alias("sign"))
    stops = parts.select("cell", "row", F.col("hi").alias("x"), F.lit(1).alias("sign"))
    order = Window.partitionBy("row").orderBy("x", "sign")
    before = F.count_if(F.col("sign") == 0).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    met = own.unionByName(begins).unionByName(stops).withColumn("k", before).where("sign <> 0 AND k > 0")
    return met.groupBy("cell", "row", "k").agg(F.sum("sign").alias("sign")).where("sign <> 0")


def sums(field: DataFrame, places: DataFrame, km: float, by: list[str], **columns: Column) -> DataFrame:
    """cell, by and, for each named column of the field (cell, by, ...), its sum over the places within the distance, the cell's own place too; nulls count as nothing.

    places: cell, lat, lon. Cells for which no place in reach has a row of the field at some `by` have no row there.
    """
    names = list(columns)
    at = positions(places)
    values = field.select("cell", *by, *[c.cast("double").alias(n) for n, c in columns.items()]).join(at, "cell")
    # Running sums need every place of a row at each time that has any.
    whole = values.select("row", *by).distinct().join(at, "row").join(values.drop("row", "k"), ["cell", *by], "left")
    along = Window.partitionBy("row", *by).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = whole.select("row", *by, "k", *[F.sum(F.coalesce(F.col(n), F.lit(0.0))).over(along).alias(n) for n in names])
    met = ends(places, km).join(running, ["row", "k"])
    return met.groupBy("cell", *by).agg(*[F.sum(F.col("sign") * F.col(n)).alias(n) for n in names])


def local_coherence(phases: DataFrame, places: DataFrame, km: float, least: int = 4) -> DataFrame:
    """cell, t, r: the resultant of the phases within the distance of each cell; null with fewer than `least` of them. phases: cell, t, phase."""
    here = F.col("phase").isNotNull().cast("int")
    s = sums(phases, places, km, ["t"], c=F.cos("phase"), s=F.sin("phase"), n=here).withColumn("n", F.round("n"))
    return s.where("n > 0").select("cell", "t", F.when(F.col("n") >= least, F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")).alias("r"))


def local_dispersion(values: DataFrame, places: DataFrame, km: float, least: int = 4) -> DataFrame:
    """cell, n, spread: population spread of v within the distance of each cell with at least `least` values. values: cell, v."""
    middle = values.agg(F.avg("v").alias("_m"))  # one row; sums of squares about it lose fewer digits
    off = values.crossJoin(F.broadcast(middle)).withColumn("_d", F.col("v") - F.col("_m"))
    s = sums(off, places, km, [], n=F.col("v").isNotNull().cast("int"), a=F.col("_d"), b=F.col("_d") * F.col("_d")).withColumn("n", F.round("n").cast("long"))
    mean = F.col("a") / F.col("n")
    return s.where(F.col("n") >= least).select("cell", "n", F.sqrt(F.greatest(F.lit(0.0), F.col("b") / F.col("n") - mean * mean)).alias("spread"))


def defect_density(plaquettes: DataFrame, places: DataFrame, km: float, least: int = 4) -> DataFrame:
    """cell, density: share of the plaquettes within the distance of each cell that hold a defect (winding of at least a half), averaged over time. plaquettes: cell, t, winding."""
    known = plaquettes.where("winding IS NOT NULL")
    s = sums(known, places, km, ["t"], n=F.lit(1), d=(F.abs("winding") >= 0.5).cast("int"))
    return s.where(F.round("n") >= least).groupBy("cell").agg(F.avg(F.round("d") / F.round("n")).alias("density"))
