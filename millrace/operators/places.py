"""Places: free-text locations to coordinates by a gazetteer, firms by distance, and radius joins over a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.keys import name_key

# The places that the catalogue knows, in their order, and the centre of distances.
CLIFTON = (40.8584, -74.1638)
CITIES = [
    ("clifton", "nj", 40.8584, -74.1638), ("newark", "nj", 40.7357, -74.1724), ("jersey city", "nj", 40.7178, -74.0431), ("hoboken", "nj", 40.7439, -74.0324),
    ("parsippany", "nj", 40.8578, -74.426), ("paterson", "nj", 40.9168, -74.1718), ("montclair", "nj", 40.8259, -74.209), ("morristown", "nj", 40.7968, -74.4815),
    ("edison", "nj", 40.5187, -74.4121), ("princeton", "nj", 40.3573, -74.6672), ("trenton", "nj", 40.2171, -74.7429), ("new york", "ny", 40.7128, -74.006),
    ("new york city", "ny", 40.7128, -74.006), ("brooklyn", "ny", 40.6782, -73.9442), ("white plains", "ny", 41.034, -73.7629), ("yonkers", "ny", 40.9312, -73.8988),
    ("stamford", "ct", 41.0534, -73.5387), ("philadelphia", "pa", 39.9526, -75.1652), ("los angeles", "ca", 34.0522, -118.2437), ("san francisco", "ca", 37.7749, -122.4194),
    ("san jose", "ca", 37.3382, -121.8863), ("seattle", "wa", 47.6062, -122.3321), ("austin", "tx", 30.2672, -97.7431), ("boston", "ma", 42.3601, -71.0589),
]
STATES = [
    ("nj", "new jersey", 40.0583, -74.4057), ("ny", "new york", 42.9, -75.5), ("ct", "connecticut", 41.6032, -73.0877), ("pa", "pennsylvania", 40.9, -77.8), ("ca", "california", 36.7783, -119.4179),
    ("wa", "washington", 47.7511, -120.7401), ("tx", "texas", 31.9686, -99.9018), ("ma", "massachusetts", 42.4072, -71.3824), ("fl", "florida", 27.6648, -81.5158),
]
RADIUS = 50.0
#: Cells of a band at least, rows of a cell at most, and what is added to an angle for rounding (radians).
AROUND, CELL_ROWS, SLACK = 64, 4096, 1e-6


def gazetteer(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed places as tables: (place_no, city, state, lat, lng) and (state, name, lat, lng)."""
    cities = spark.createDataFrame([(i, *c) for i, c in enumerate(CITIES)], "place_no int, city string, state string, lat double, lng double")
    return cities, spark.createDataFrame(STATES, "state string, name string, lat double, lng double")


def is_remote(location: Column) -> Column:
    return F.coalesce(location.rlike(r"(?i)\bremote\b"), F.lit(False))


def parsed_location(location: Column) -> tuple[Column, Column]:
    """City and the last part of a location, which may be a state's name or end with its letters; both lower case or null."""
    cleaned = F.trim(F.regexp_replace(location, r"(?i),?\s*(united states|usa|u\.s\.a\.|us)\.?$", ""))
    parts = F.filter(F.transform(F.split(cleaned, ","), lambda p: F.trim(p)), lambda p: p != "")
    last = F.element_at(parts, F.when(F.size(parts) > 0, -1))
    city = F.regexp_replace(F.trim(F.lower(parts[0])), r"\s+", " ")
    return F.when(F.size(parts) > 0, city), F.lower(last)


def resolved(rows: DataFrame, location: str, cities: DataFrame, states: DataFrame) -> DataFrame:
    """``rows`` with lat, lng and precision: city, state, remote or none.

    A city with its state comes first, then a city of that name in any state (the
    first in the gazetteer) where no state is given, then the state's centre.  The
    gazetteer may have any size: it is met by equi-joins on its keys, which must be
    unique.
    """
    city, last = parsed_location(F.col(location))
    abbreviated = F.regexp_extract(last, r"(?:^|\s)([a-z]{2})$", 1)
    named = states.select(F.col("name").alias("last_part"), F.col("state").alias("named_state"))
    split = rows.withColumns({"first_part": city, "last_part": last, "short_state": F.nullif(abbreviated, F.lit(""))}).join(named, "last_part", "left")
    split = split.withColumn("found_state", F.coalesce("short_state", "named_state"))
    alone = F.col("found_state").isNotNull() & ~F.contains(F.regexp_replace(F.trim(F.regexp_replace(F.col(location), r"(?i),?\s*(united states|usa|u\.s\.a\.|us)\.?$", "")), r"^[\s,]+|[\s,]+$", ""), F.lit(","))
    split = split.withColumn("found_city", F.when(~alone, F.col("first_part")))
    exact = cities.select(F.col("city").alias("found_city"), F.col("state").alias("found_state"), F.struct("lat", "lng").alias("at_city"))
    first = cities.groupBy(F.col("city").alias("found_city")).agg(F.min_by(F.struct("lat", "lng"), "place_no").alias("at_any"))
    centre = states.select(F.col("state").alias("found_state"), F.struct("lat", "lng").alias("at_state"))
    met = split.join(exact, ["found_city", "found_state"], "left").join(first, "found_city", "left").join(centre, "found_state", "left")
    at_city = F.coalesce("at_city", F.when(F.col("found_state").isNull(), F.col("at_any")))
    away = is_remote(F.col(location))
    at = F.when(~away, F.coalesce(at_city, F.col("at_state")))
    precision = F.when(away, "remote").when(at_city.isNotNull(), "city").when(F.col("at_state").isNotNull(), "state").otherwise("none")
    return met.select(*rows.columns, at["lat"].alias("lat"), at["lng"].alias("lng"), precision.alias("precision"))


def classified(rows: DataFrame, location: str, stored: str, cities: DataFrame, states: DataFrame, radius: float = RADIUS, centre: tuple[float, float] = CLIFTON) -> DataFrame:
    """``rows`` with bucket (local, outside, unknown), miles (one decimal) and precision.

    Remote work is local without a distance; a stored distance is trusted; an unknown
    place is never near.
    """
    at = resolved(rows, location, cities, states)
    stored_miles = F.when(F.col("precision") != "remote", F.when(~F.isnan(stored), F.col(stored)))
    computed = geo.rounded(geo.miles(F.lit(centre[0]), F.lit(centre[1]), F.col("lat"), F.col("lng")))
    miles = F.coalesce(geo.rounded(stored_miles), computed)
    precision = F.when(stored_miles.isNotNull(), "city").otherwise(F.col("precision"))
    bucket = F.when(precision == "remote", "local").when(F.coalesce(stored_miles, computed) <= radius, "local").when(miles.isNotNull(), "outside").otherwise("unknown")
    return at.select(*rows.columns, bucket.alias("bucket"), miles.alias("miles"), precision.alias("precision"))


def local_firms(firms: DataFrame, jobs: DataFrame, cities: DataFrame, states: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Each firm (firm_id, name) with its nearest placeable job (job_id, company, location, stored_miles) by name.

    The nearest is the least (distance, job_id), distances unknown last; its bucket is
    the firm's, and a firm without one is ``unknown``.  Jobs are reduced to one row a
    name before the join.
    """
    placed = classified(jobs, "location", "stored_miles", cities, states, radius).withColumn("name_key", name_key(F.col("company")))
    far = F.coalesce("miles", F.lit(float("inf")))
    known = F.col("bucket") != "unknown"
    nearest = F.min(F.when(known, F.struct(far.alias("far"), "job_id", "location", "miles", "bucket", "precision")))
    best = placed.groupBy("name_key").agg(F.count("*").alias("jobs"), nearest.alias("best")).where("name_key IS NOT NULL")
    met = firms.withColumn("name_key", name_key(F.col("name"))).join(best, "name_key", "left")
    return met.select(
        *firms.columns, F.coalesce("best.bucket", F.lit("unknown")).alias("bucket"), F.col("best.miles").alias("miles"), F.col("best.location").alias("location"),
        (F.coalesce("best.precision", F.lit("")) == "remote").alias("remote"), F.coalesce("jobs", F.lit(0).cast("long")).alias("jobs"),
    )


def firm_order(pinned: str) -> list[Column]:
    """A pinned firm first, then by distance with unknown ones last, then by name."""
    return [(F.col("name") == pinned).desc(), F.col("miles").asc_nulls_last(), F.col("name"), F.col("firm_id")]


def firm_counts(firms: DataFrame) -> DataFrame:
    """One row: how many firms were checked, are placed, near, far, unknown, and near with jobs."""
    bucket = F.col("bucket")
    return firms.agg(
        F.count("*").alias("checked"), F.count_if(bucket != "unknown").alias("placed"), F.count_if(bucket == "local").alias("inside"), F.count_if(bucket == "outside").alias("outside"),
        F.count_if(bucket == "unknown").alias("unknown"), F.count_if((bucket == "local") & (F.col("jobs") > 0)).alias("offering"),
    )


def _on_globe(rows: DataFrame, key: str, suffix: str) -> DataFrame:
    """The placed rows: key, lat, lng, the latitude's cosine, and the point on a globe of radius 1 (x, y, z)."""
    lat, lng = F.radians("lat"), F.radians("lng")
    cos = F.cos(lat)
    columns = {"lat": F.col("lat"), "lng": F.col("lng"), "cos": cos, "x": cos * F.cos(lng), "y": cos * F.sin(lng), "z": F.sin(lat)}
    # NaN sorts after all numbers, so such a place would pass for near
    return rows.where("lat IS NOT NULL AND lng IS NOT NULL").where(~F.isnan(cos * F.cos(lng))).select(key, *(c.alias(name + suffix) for name, c in columns.items()))


def within(rows: DataFrame, key: str, centres: DataFrame, centre_key: str, radius: float) -> DataFrame:
    """key, centre_key, miles: all pairs at most ``radius`` miles apart; both sides have lat and lng.

    The globe is cut into bands of latitude of a quarter of the radius, and those into
    cells about as wide, ``AROUND`` of them at least, so that the places near a pole are
    many cells too.  A centre meets the cells that its circle touches; a cell of more than
    ``CELL_ROWS`` rows is dealt out in blocks, which all its centres meet.  Pairs are told
    apart by the product of their points, and only those near the edge of the circle by
    their distance.  Rows without coordinates are near nothing.
    """
    angle = radius / geo.EARTH_MILES
    reach = min(angle * (1 + SLACK) + SLACK, math.pi)
    bands = max(1, int(math.pi / max(reach / 4, math.pi / 20_000)))
    height, half = math.pi / bands, math.pi / 2
    count = lambda b: F.greatest(F.lit(AROUND), F.ceil(2 * bands * F.cos((b + 0.5) * height - half)).cast("int"))
    band = lambda at: F.least(F.lit(bands - 1), F.greatest(F.lit(0), F.floor((at + half) / height).cast("int")))
    cell = lambda at, n: F.floor((at + math.pi) / (2 * math.pi) * n).cast("int")
    placed = _on_globe(rows, key, "").withColumn("band", band(F.asin("z"))).withColumn("n", count(F.col("band")))
    placed = placed.withColumn("cell", F.pmod(cell(F.atan2("y", "x"), F.col("n")), F.col("n"))).drop("n")

    own = _on_globe(centres, centre_key, "2").withColumns({"north": F.asin("z2"), "east": F.atan2("y2", "x2")})
    own = own.withColumn("band", F.explode(F.sequence(band(F.col("north") - reach), band(F.col("north") + reach))))
    # the widest part of a circle within a band is at an edge, or where the circle is widest at all
    edges = [F.greatest(F.lit(-half), F.least(F.lit(half), (F.col("band") + i) * height - half)) for i in (0, 1)]
    widest = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin("north") / max(math.cos(reach), 1e-9))))
    ratio = lambda at: (math.cos(reach) - F.sin("north") * F.sin(at)) / F.greatest(F.cos("north") * F.cos(at), F.lit(1e-15))
    least = F.least(*map(ratio, (*edges, F.greatest(edges[0], F.least(edges[1], widest)))))
    wide = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), least))) if reach < half else F.lit(math.pi)
    spans = own.withColumns({"n": count(F.col("band")), "wide": wide + SLACK})
    spans = spans.withColumns({"first": cell(F.col("east") - F.col("wide"), F.col("n")), "last": cell(F.col("east") + F.col("wide"), F.col("n"))})
    spread = spans.withColumn("at", F.explode(F.sequence("first", F.least("last", F.col("first") + F.col("n") - 1))))
    spread = spread.select(centre_key, "lat2", "lng2", "cos2", "x2", "y2", "z2", "band", F.pmod("at", "n").alias("cell"))

    large = placed.groupBy("band", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    dealt = placed.join(large, ["band", "cell"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"), F.lit(0))).drop("blocks")
    blocks = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    copies = spread.join(large, ["band", "cell"], "left").withColumn("block", F.explode(blocks)).drop("blocks")

    product = F.col("x") * F.col("x2") + F.col("y") * F.col("y2") + F.col("z") * F.col("z2")
    far = geo.miles(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"), F.col("cos"), F.col("cos2"))
    inner = max(angle * (1 - SLACK) - SLACK, 0.0)
    surely = product >= (math.cos(inner) if inner < math.pi else -2.0)
    near = (product >= math.cos(reach) - 1e-15) & ((surely & (F.lit(inner) > 0)) | (far <= radius))
    # a merge join: the centres' cells are many more than their rows, which a size estimate doesn't see
    return dealt.join(copies.hint("merge"), ["band", "cell", "block"]).where(near).select(key, centre_key, far.alias("miles"))
