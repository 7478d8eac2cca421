"""Readers of the catalogue's sources: tables, employer CSV, board JSON, list pages, mail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.keys import name_key

POSTING = "source_job_id string, title string, location string, workplace string, apply_url string, description string, posted_text string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in ranges of its key; filters and columns are pushed down."""
    options = {"url": url, "dbtable": name, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**options).load()


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV with a header; quotes double, fields may hold line feeds, blank fields are null."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select([F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in raw.columns])


def approved_employers(rows: DataFrame, name: str, required: list[str]) -> DataFrame:
    """Employers by first row of each lower-cased name; adds row_index and status (kept, duplicate, rejected)."""
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"the header lacks {missing}")
    numbered = rows.withColumn("row_index", F.monotonically_increasing_id()).withColumn("_key", name_key(F.col(name)))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("row_index")) == 1
    status = F.when(F.coalesce("_key", F.lit("")) == "", "rejected").when(first, "kept").otherwise("duplicate")
    return numbered.withColumn("status", status).drop("_key")


def _remote(location: Column) -> Column:
    return F.when(location.rlike(r"(?i)\bremote\b"), "Remote").otherwise("OnSite")


def greenhouse(pages: DataFrame) -> DataFrame:
    """Postings of ``{"jobs": [...]}`` documents in column ``body``."""
    schema = "jobs array<struct<id: string, title: string, location: struct<name: string>, absolute_url: string, content: string, updated_at: string>>"
    j = pages.select("board", F.explode(F.from_json("body", schema)["jobs"]).alias("j"))
    return j.select("board", F.col("j.id").alias("source_job_id"), "j.title", F.col("j.location.name").alias("location"), _remote(F.col("j.location.name")).alias("workplace"), F.col("j.absolute_url").alias("apply_url"), F.col("j.content").alias("description"), F.col("j.updated_at").alias("posted_text"))


def lever(pages: DataFrame) -> DataFrame:
    """Postings of top-level arrays; creation times are epoch milliseconds."""
    schema = "array<struct<id: string, text: string, categories: struct<location: string>, workplaceType: string, hostedUrl: string, descriptionPlain: string, createdAt: long>>"
    j = pages.select("board", F.explode(F.from_json("body", schema)).alias("j"))
    return j.select("board", F.col("j.id").alias("source_job_id"), F.col("j.text").alias("title"), F.col("j.categories.location").alias("location"), F.coalesce("j.workplaceType", _remote(F.col("j.categories.location"))).alias("workplace"), F.col("j.hostedUrl").alias("apply_url"), F.col("j.descriptionPlain").alias("description"), F.col("j.createdAt").cast("string").alias("posted_text"))


def ashby(pages: DataFrame) -> DataFrame:
    schema = "jobs array<struct<id: string, title: string, location: string, isRemote: boolean, jobUrl: string, descriptionPlain: string, publishedAt: string>>"
    j = pages.select("board", F.explode(F.from_json("body", schema)["jobs"]).alias("j"))
    return j.select("board", F.col("j.id").alias("source_job_id"), "j.title", "j.location", F.when(F.col("j.isRemote"), "Remote").otherwise("OnSite").alias("workplace"), F.col("j.jobUrl").alias("apply_url"), F.col("j.descriptionPlain").alias("description"), F.col("j.publishedAt").alias("posted_text"))


def smartrecruiters(pages: DataFrame) -> DataFrame:
    schema = "content array<struct<id: string, name: string, location: struct<city: string, region: string, remote: boolean>, ref: string, sections: array<struct<title: string, text: string>>, releasedDate: string>>"
    j = pages.select("board", F.explode(F.from_json("body", schema)["content"]).alias("j"))
    text = F.array_join(F.transform("j.sections", lambda s: F.concat_ws("\n", s.title, s.text)), "\n\n")
    return j.select("board", F.col("j.id").alias("source_job_id"), F.col("j.name").alias("title"), F.concat_ws(", ", "j.location.city", "j.location.region").alias("location"), F.when(F.col("j.location.remote"), "Remote").otherwise("OnSite").alias("workplace"), F.col("j.ref").alias("apply_url"), text.alias("description"), F.col("j.releasedDate").alias("posted_text"))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters}


def postings(pages: DataFrame) -> DataFrame:
    """All supported boards' postings from pages (kind, board, body), by their kind."""
    out = None
    for kind, adapter in ADAPTERS.items():
        own = adapter(pages.where(F.col("kind") == kind)).withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out


def unsupported(pages: DataFrame) -> DataFrame:
    """Boards of a kind without an adapter, which is not the same as an empty board."""
    return pages.where(~F.col("kind").isin(*ADAPTERS)).select("kind", "board").distinct()


def next_data(html: Column) -> Column:
    """The JSON text embedded in a page's ``__NEXT_DATA__`` script, or null."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


def table_feed(text: DataFrame) -> DataFrame:
    """Rows (company, title, location, url) of HTML tables in Markdown; "↳" repeats the last company."""
    rows = text.select("feed", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)).alias("pos", "row"))
    cells = rows.withColumn("cells", F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1)).where(F.size("cells") >= 4)
    bare = lambda i: F.trim(F.regexp_replace(F.col("cells")[i], r"(?s)<[^>]+>", " "))
    found = cells.select("feed", "pos", F.when(bare(0) != "↳", bare(0)).alias("name"), bare(1).alias("title"), bare(2).alias("location"), F.regexp_extract(F.col("cells")[3], r"href=[\"']([^\"']+)", 1).alias("url"))
    w = Window.partitionBy("feed").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.withColumn("company", F.last("name", ignorenulls=True).over(w)).drop("name")


def pipe_feed(text: DataFrame) -> DataFrame:
    """Rows of Markdown pipe tables, without header and separator."""
    lines = text.select("feed", F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.trim("line").startswith("|"))
    cells = lines.withColumn("cells", F.transform(F.split(F.trim("line"), r"\|"), lambda c: F.trim(c)))
    return cells.where(~F.col("line").rlike(r"^\s*\|[\s:|-]+\|?\s*$") & (F.lower(F.col("cells")[1]) != "company") & (F.size("cells") >= 5)).select("feed", "pos", F.col("cells")[1].alias("company"), F.col("cells")[2].alias("title"), F.col("cells")[3].alias("location"))


def mail_body(encoded: Column) -> Column:
    """Text of a base64url body."""
    return F.decode(F.unbase64(F.translate(encoded, "-_", "+/")), "utf-8")


_LD = "`@type`: string, title: string, description: string, datePosted: string, employmentType: string, url: string, hiringOrganization: struct<name: string>, jobLocation: struct<address: struct<addressLocality: string, addressRegion: string>>"


def structured_postings(pages: DataFrame, html: str = "html") -> DataFrame:
    """JobPosting objects of the pages' JSON-LD scripts: alone, in arrays or in an ``@graph``; malformed scripts give none."""
    script = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
    blocks = pages.withColumn("_block", F.explode(F.regexp_extract_all(html, F.lit(script), 1)))
    one = f"struct<{_LD}, `@graph`: array<struct<{_LD}>>>"
    whole = F.from_json(F.when(F.trim("_block").startswith("["), F.col("_block")).otherwise(F.concat(F.lit("["), "_block", F.lit("]"))), f"array<{one}>")
    plain = F.transform(F.coalesce(whole, F.array().cast(f"array<{one}>")), lambda x: F.array_append(F.coalesce(x["@graph"], F.array().cast(f"array<struct<{_LD}>>")), F.struct(*[x[n].alias(n) for n in ("@type", "title", "description", "datePosted", "employmentType", "url", "hiringOrganization", "jobLocation")])))
    found = F.filter(F.flatten(plain), lambda x: x["@type"] == "JobPosting")
    others = [c for c in pages.columns if c != html]
    j = blocks.select(*others, F.explode(found).alias("_j"))
    place = F.nullif(F.concat_ws(", ", "_j.jobLocation.address.addressLocality", "_j.jobLocation.address.addressRegion"), F.lit(""))
    return j.select(*others, "_j.title", F.col("_j.hiringOrganization.name").alias("company"), place.alias("location"), F.col("_j.employmentType").alias("employment_type"), F.col("_j.datePosted").alias("posted_text"), F.col("_j.url").alias("apply_url"), "_j.description")
