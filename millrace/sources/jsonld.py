"""JobPosting objects in pages' JSON-LD, at any place up to a depth, by VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEEPEST = 5
SCRIPT = r"(?is)<script\b[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
# Entities that occur in scripts.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def _is(value: str, kind: str) -> Column:
    return F.expr(f"startswith(schema_of_variant({value}), '{kind}')")


def children(value: str) -> Column:
    """An array's or object's own arrays and objects with their places; ``@graph`` comes first, other keys by name."""
    kind = "array<struct<place: int, value: variant>>"
    items = F.expr(f"transform(try_cast({value} AS ARRAY<VARIANT>), (x, i) -> named_struct('place', i, 'value', x))")
    fields = F.expr(f"transform(map_entries(try_cast({value} AS MAP<STRING, VARIANT>)), (x, i) -> named_struct('place', IF(x.key = '@graph', -1, i), 'value', x.value))")
    both = F.when(_is(value, "ARRAY"), items).when(_is(value, "OBJECT"), fields)
    return F.filter(F.coalesce(both, F.array().cast(kind)), lambda x: F.coalesce(_nested(x.value), F.lit(False)))


def _nested(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return F.startswith(shape, F.lit("OBJECT")) | F.startswith(shape, F.lit("ARRAY"))


def is_posting(value: str) -> Column:
    """An object with the type JobPosting, in any case, alone or in a list."""
    one = F.lower(F.expr(f"try_variant_get({value}, '$[\"@type\"]', 'string')"))
    many = F.expr(f"exists(try_variant_get({value}, '$[\"@type\"]', 'array<string>'), t -> lower(t) = 'jobposting')")
    return _is(value, "OBJECT") & F.coalesce((one == "jobposting") | F.coalesce(many, F.lit(False)), F.coalesce(many, F.lit(False)))


def _text(path: str, value: str = "value") -> Column:
    """The string at a path, trimmed; null for blank ones and other kinds."""
    at = f"try_variant_get({value}, '{path}', 'variant')"
    return F.when(F.expr(f"schema_of_variant({at}) = 'STRING'"), F.nullif(F.trim(F.expr(f"try_variant_get({value}, '{path}', 'string')")), F.lit("")))


def _first_text(path: str) -> Column:
    """The first string at a path: itself, the first of a list, or an object's value, name or identifier."""
    firsts = F.filter(F.expr(f"try_variant_get(value, '{path}', 'array<string>')"), lambda x: F.trim(x) != "")
    return F.coalesce(_text(path), F.trim(F.get(firsts, F.lit(0))), *(_text(f"{path}.{k}") for k in ("value", "name", "identifier")))


def _location() -> Column:
    """Every place's parts joined by commas, the different places by semicolons."""
    listed = F.coalesce(F.expr("try_variant_get(value, '$.jobLocation', 'array<variant>')"), F.array(F.expr("try_variant_get(value, '$.jobLocation', 'variant')")))
    parts = ("addressLocality", "addressRegion", "addressCountry", "postalCode")

    def one(place: Column) -> Column:
        address = F.coalesce(F.try_variant_get(place, "$.address", "map<string, variant>"), F.try_variant_get(place, "$", "map<string, variant>"))
        texts = [F.when(F.schema_of_variant(address[p]) == "STRING", F.nullif(F.trim(address[p].try_cast("string")), F.lit(""))) for p in parts]
        return F.nullif(F.concat_ws(", ", *texts), F.lit(""))

    return F.nullif(F.array_join(F.array_distinct(F.array_compact(F.transform(F.filter(listed, lambda p: p.isNotNull()), one))), "; "), F.lit(""))


def found_postings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, company, location, employment_type, posted_text, apply_url, description of each page's first JobPosting.

    Scripts are looked through in order, and each from the outside in: a value, then what
    is in it, ``@graph`` before other keys, down to ``DEEPEST`` levels.  Each level is a
    projection of the one above, so nothing is shuffled but the pages' first hits.
    Malformed scripts give none; pages without a hit have no row.
    """
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(SCRIPT), 1)).alias("script", "raw"))
    level = blocks.select(key, F.array("script").alias("path"), F.try_parse_json(decoded(F.trim("raw"))).alias("value")).where("value IS NOT NULL")
    hits = None
    for depth in range(DEEPEST + 1):
        hit = F.coalesce(is_posting("value"), F.lit(False))
        here = level.where(hit)
        hits = here if hits is None else hits.unionByName(here)
        if depth < DEEPEST:
            below = level.where(~hit).select(key, "path", F.explode(children("value")).alias("child"))
            level = below.select(key, F.concat("path", F.array("child.place")).alias("path"), F.col("child.value").alias("value"))
    told = hits.select(
        key, "path", _text("$.title").alias("title"), _first_text("$.hiringOrganization").alias("company"), _location().alias("location"), _first_text("$.employmentType").alias("employment_type"),
        _text("$.datePosted").alias("posted_text"), _text("$.url").alias("apply_url"), _text("$.description").alias("description"),
    )
    names = ["title", "company", "location", "employment_type", "posted_text", "apply_url", "description"]
    first = told.groupBy(key).agg(F.min_by(F.struct(*names), "path").alias("first"))
    return first.select(key, *(F.col(f"first.{n}").alias(n) for n in names))
