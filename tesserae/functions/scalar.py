"""Column expressions on places, angles, calendars, units and verdicts; all of them run inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
OMEGA = 7.2921e-5


def wrap_lon(lon: Column) -> Column:
    """Degrees east within [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def rotated_lon(lon: Column, offset: float) -> Column:
    """Degrees east of the offset, within [0, 360): a basin across the date line becomes contiguous."""
    return F.pmod(lon - offset, F.lit(360.0))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Closed intervals; a box whose west lies east of its east wraps around."""
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def wrapped(angle: Column) -> Column:
    """An angle within (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def cell_area_km2(lat: Column, dlat: float, dlon: float) -> Column:
    return F.cos(F.radians(lat)) * (dlat * dlon * (EARTH_KM * math.pi / 180) ** 2)


def coriolis(lat: Column) -> Column:
    return 2 * OMEGA * F.sin(F.radians(lat))


def age_to_year(ka: Column) -> Column:
    """Calendar year of an age in thousands of years before 1950."""
    return 1950 - 1000 * ka


def decimal_year(year: Column, month: Column) -> Column:
    return year + (month - 0.5) / 12


def month_index(year: Column, month: Column, first: int) -> Column:
    """Months since January of the first year."""
    return (year - first) * 12 + month - 1


def co2_ppm(years: Column) -> Column:
    """One per cent a year on 284.32 ppm."""
    return 284.32 * F.pow(F.lit(1.01), years)


def masked(v: Column, low: float) -> Column:
    """Values at or below the sentinel, and NaN, are missing."""
    return F.when(~F.isnan(v) & (v > low), v)


def safe_corr(x: Column, y: Column, over=None) -> Column:
    """Pearson's r of the pairs that are both there, null where either is constant (corr() itself raises an error then)."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    on = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    vx, vy = on(F.var_pop(a)), on(F.var_pop(b))
    return F.when((vx > 0) & (vy > 0), on(F.covar_pop(a, b)) / F.sqrt(vx * vy))


def zscore(x: Column, over) -> Column:
    """Population z-score; null where nothing varies."""
    spread = F.stddev_pop(x).over(over)
    return F.when(spread > 0, (x - F.avg(x).over(over)) / spread)


def band_verdict(x: Column, low: float, high: float) -> Column:
    """A three-way rule: below, between, above."""
    return F.when(x < low, "falsified").when(x <= high, "deferred").when(x > high, "supported")


# Closures of coherence r against the gradient d: the simple form with a time scale, the weak-coupling limit, and the exponential family.
def closure_simple(d: Column, tau: float) -> Column:
    return 1 / F.sqrt(1 + tau * F.greatest(d, F.lit(0.0)))


def closure_weak(d: Column, k: float) -> Column:
    return F.when(d > 0, k / (2 * F.greatest(d, F.lit(1e-12)))).otherwise(1.0)


def closure_exp(d: Column, tau: float, r0: float = 1.0) -> Column:
    return r0 * F.exp(-tau * d)


def days_of(calendar: str, year: Column, month: Column) -> Column:
    """Days of a month in a calendar: standard, noleap (no 29 February), 360_day (all months of thirty)."""
    if calendar == "360_day":
        return F.lit(30)
    last = F.day(F.last_day(F.make_date(year, month, F.lit(1))))
    return last if calendar == "standard" else F.when(month == 2, 28).otherwise(last)


def calendar_day(calendar: str, days: Column, first_year: int) -> tuple[Column, Column, Column]:
    """Year, month and day of a count of days since the first of January of first_year: for calendars that no date type holds."""
    if calendar == "standard":
        date = F.date_add(F.lit(f"{first_year}-01-01").cast("date"), days.cast("int"))
        return F.year(date), F.month(date), F.day(date)
    if calendar == "360_day":
        return first_year + F.floor(days / 360), F.floor(F.pmod(days, F.lit(360)) / 30) + 1, F.pmod(days, F.lit(30)) + 1
    if calendar != "noleap":
        raise ValueError(f"unknown calendar {calendar!r}")
    starts = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]  # days before each month of a year of 365
    day = F.pmod(days, F.lit(365))
    month = sum(F.when(day >= x, 1).otherwise(0) for x in starts)
    return first_year + F.floor(days / 365), month, day - F.element_at(F.array(*map(F.lit, starts)), month.cast("int")) + 1


def box_on_axes(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Whether a place lies in a box, whatever way the axes run: latitudes in either order, longitudes of 0 to 360 or -180 to 180, boxes across the seam as the union of two."""
    low, high = min(south, north), max(south, north)
    at = lambda x: F.pmod(x, F.lit(360.0)) if isinstance(x, Column) else F.lit(x % 360.0)
    x, w, e = at(lon), west % 360.0, east % 360.0
    across = (x >= w) & (x <= e) if w <= e else (x >= w) | (x <= e)
    return lat.between(low, high) & across
