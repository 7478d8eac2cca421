"""Distances and places (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """Great-circle distance; the cosines of the latitudes may be given."""
    cos1, cos2 = F.cos(F.radians(lat1)) if cos1 is None else cos1, F.cos(F.radians(lat2)) if cos2 is None else cos2
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + cos1 * cos2 * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(a))


def rounded(x: Column) -> Column:
    """To one decimal, halves up."""
    return F.floor(x * 10 + 0.5) / 10


def round_as_sql(x: Column, digits: int) -> Column:
    """A distance to some decimals as DuckDB rounds it: the scaled number to the nearest whole one, halves up (Spark rounds its decimal text)."""
    scaled = x * float(10**digits)
    below = F.floor(scaled)
    return (below + F.when(scaled - below >= 0.5, 1).otherwise(0)) / float(10**digits)


def place(distance: Column, remote: Column, radius: float) -> Column:
    """local, outside or unknown; remote work is local at any distance."""
    return F.when(remote, "local").when(distance.isNull(), "unknown").when(distance <= radius, "local").otherwise("outside")


def city_key(location: Column) -> Column:
    """``city, st`` in lower case, or null."""
    city, state = (F.regexp_extract(location, r"^\s*([^,]+),\s*([A-Za-z]{2})\b", g) for g in (1, 2))
    return F.when(city != "", F.lower(F.concat(F.trim(city), F.lit(", "), state)))
