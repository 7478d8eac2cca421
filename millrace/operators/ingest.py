"""Ingestion of a batch of sightings into a table of jobs, as if they came one by one.

A sighting finds its job by the first of four tiers of identity that any job meets,
and of those jobs the first:

1. source and the source's own id;
2. company and requisition, where there is one;
3. company and canonical URL: the sighting's (the official one, else its source's)
   among the job's official, source's and other URLs;
4. company, source, title key, location key and requisition (none equals none).

It updates that job or makes a new one, which later sightings of the same batch may
find.  Rows that can ever meet share a key of some tier, so groups of rows linked by keys
are independent; within a group the rows are folded in order.  A URL links rows of one
company.  Only by tier 1 can a job get a URL from a sighting of another company (or of
none), so the URLs of rows whose source and id several companies have link any rows.
Spark finds the groups, deals them out and sorts them; a task holds the jobs' keys of one
group.

What an update keeps: a posting date goes only to a surer one; a missing URL, an empty
description or a missing classification never replaces a value.  Outcomes are ``new``,
``updated`` (description, source URL or official URL differ) and ``unchanged``.
Texts don't take part in the fold: their digests do, and they are joined at the end.

Defined results: a null source or id matches nothing in tiers 1 and 4; a null company
nothing in tiers 2 to 4; blank requisitions and URLs are none; sightings with equal
``seq`` come in any order, so it should be unique; empty tables are empty; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, keys
from .graph import linked_roots
from .identity import first_with_any_url

# Hosts that list other employers' postings.
AGGREGATORS = ["jobright.ai", "intern-list.com", "simplify.jobs", "linkedin.com", "indeed.com", "glassdoor.com", "ziprecruiter.com"]

JOB = ["source", "source_job_id", "company", "requisition_id", "title", "location", "official_url", "source_url", "other_url", "description", "posted_at", "confidence", "classification"]
_OUT = "kind string, seq long, outcome string, tier int, job_id long, made_by long, last_seq long, sightings long, text_from long, source_url string, official_url string, posted_at timestamp, rank int, classification string"
_SENT = [
    "fold_group", "known", "seq", "company", "id_key", "requisition_key", "title_key", "official_key", "source_key", "other_key", "direct_key",
    "official_url", "source_url", "direct_url", "text", "has_text", "posted_at", "rank", "classification",
]


def _blank(c: str | Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def dealt_out(rows: DataFrame, key: str) -> DataFrame:
    """The rows over as many tasks as a shuffle has, for work by the row on a table that may be of one row group.

    The number is given, as adaptive execution would join small parts whose work is long.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _told(rows: DataFrame, known: bool, seq: str) -> DataFrame:
    """What jobs or sightings say, with texts as digests."""
    return rows.select(
        F.lit(known).alias("known"), F.col(seq).cast("long").alias("seq"), *(F.col(c).cast("string").alias(c) for c in ("company", "source", "source_job_id", "location", "classification")),
        _blank("requisition_id").alias("requisition"), F.coalesce("title", F.lit("")).alias("title"), *(_blank(c).alias(c) for c in ("official_url", "source_url", "other_url")),
        F.md5(F.coalesce("description", F.lit(""))).alias("text"), (F.coalesce("description", F.lit("")) != "").alias("has_text"),
        F.col("posted_at").cast("timestamp").alias("posted_at"), dates.confidence_rank(F.col("confidence")).cast("int").alias("rank"),
    )


def _keyed(told: DataFrame) -> DataFrame:
    """The rows' keys.

    What several expressions use is a column of its own before them; within one
    expression each use would work it out again.
    """
    named = dealt_out(told, "seq").withColumns({
        "title": keys.title_key(F.col("title")), "location": keys.location_key(F.col("location")), "from_aggregator": keys.host_in(F.col("source_url"), AGGREGATORS),
        "official_at": keys.canonical_url(F.col("official_url")), "other_at": keys.canonical_url(F.col("other_url")),
    })
    source_at = F.when(F.col("source_url") == F.col("official_url"), F.col("official_at")).otherwise(keys.canonical_url(F.col("source_url")))
    hashed = lambda *c: F.when(F.greatest(*(x.isNull().cast("int") for x in (*c, F.lit(1)))) == 0, F.unhex(F.sha2(F.to_json(F.array(*c)), 256)))
    place = lambda at: hashed(F.lit("3"), F.col(at))
    direct = lambda c: F.when(~F.col("from_aggregator"), c)
    return named.withColumn("source_at", source_at).withColumn("source_key", place("source_at")).select(
        "known", "seq", hashed(F.lit("1"), F.col("source"), F.col("source_job_id")).alias("id_key"), hashed(F.lit("2"), F.col("company"), F.col("requisition")).alias("requisition_key"),
        hashed(F.lit("4"), F.col("company"), F.col("source"), F.col("title"), F.col("location"), F.coalesce(F.concat(F.lit("="), "requisition"), F.lit(""))).alias("title_key"),
        place("official_at").alias("official_key"), "source_key", place("other_at").alias("other_key"), direct(F.col("source_key")).alias("direct_key"),
        "company", "official_url", "source_url", direct(F.col("source_url")).alias("direct_url"), "text", "has_text", "posted_at", "rank", "classification",
    )


def _fold() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The fold of sorted groups, self-contained so that tasks need nothing else."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_OUT))
    at = {name: i for i, name in enumerate(_SENT)}

    class Group:
        """The jobs of one group, in order, and where to find them."""

        def __init__(self) -> None:
            self.jobs: list[dict] = []
            self.by_key: dict[bytes | tuple, list[int]] = {}

        def file(self, key: bytes | None, number: int) -> None:
            """Makes a job known by a key, or by one of its URLs within its company."""
            job = self.jobs[number]
            if key in job["urls"].values():
                key = (job["company"], key) if job["company"] is not None and key is not None else None
            if key is not None:
                found = self.by_key.setdefault(key, [])
                i = bisect_left(found, number)
                if i == len(found) or found[i] != number:
                    found.insert(i, number)

        def leave(self, keys: list[bytes | None], number: int) -> None:
            """Forgets a job under the URLs that it no longer has, so that a search ends at its first entry."""
            job = self.jobs[number]
            for key in set(keys).difference(job["urls"].values()) if job["company"] is not None else ():
                found = self.by_key.get((job["company"], key), [])
                i = bisect_left(found, number)
                if i < len(found) and found[i] == number:
                    del found[i]

        def add(self, row: tuple, known: bool) -> int:
            number = len(self.jobs)
            official = at["official_url"] if known or row[at["official_url"]] is not None else at["direct_url"]
            official_key = at["official_key"] if official == at["official_url"] else at["direct_key"]
            job = {
                "job_id": row[at["seq"]] if known else None, "made_by": None if known else row[at["seq"]], "last": None if known else row[at["seq"]],
                "company": row[at["company"]], "sightings": 0 if known else 1, "text_from": None if known else row[at["seq"]], "text": row[at["text"]], "source_url": row[at["source_url"]],
                "official_url": row[official], "urls": {"official": row[official_key], "source": row[at["source_key"]], "other": row[at["other_key"]]},
                "posted_at": row[at["posted_at"]], "rank": row[at["rank"]], "classification": row[at["classification"]],
            }
            self.jobs.append(job)
            for key in (row[at["id_key"]], row[at["requisition_key"]], row[at["title_key"]], *job["urls"].values()):
                self.file(key, number)
            return number

        def find(self, row: tuple) -> tuple[int, int] | None:
            """Tier and number of the sighting's job."""
            wanted = row[at["official_key"]] if row[at["official_key"]] is not None else row[at["source_key"]]
            near = (row[at["company"]], wanted) if wanted is not None and row[at["company"]] is not None else None
            for tier, key in enumerate((row[at["id_key"]], row[at["requisition_key"]], near, row[at["title_key"]]), 1):
                for number in self.by_key.get(key, ()) if key is not None else ():
                    if tier != 3 or wanted in self.jobs[number]["urls"].values():
                        return tier, number
            return None

        def update(self, row: tuple, number: int) -> str:
            job = self.jobs[number]
            official, official_key = row[at["official_url"]], row[at["official_key"]]
            if official is None:
                official, official_key = job["official_url"], job["urls"]["official"]
            if official is None:
                official, official_key = row[at["direct_url"]], row[at["direct_key"]]
            changed = row[at["text"]] != job["text"] or row[at["source_url"]] != job["source_url"] or official != job["official_url"]
            job["last"], job["sightings"] = row[at["seq"]], job["sightings"] + 1
            if row[at["posted_at"]] is not None and (job["posted_at"] is None or row[at["rank"]] > job["rank"]):
                job["posted_at"], job["rank"] = row[at["posted_at"]], row[at["rank"]]
            if row[at["classification"]] is not None:
                job["classification"] = row[at["classification"]]
            had = list(job["urls"].values())
            job["official_url"], job["urls"]["official"] = official, official_key
            self.file(official_key, number)
            if changed and row[at["has_text"]] and row[at["text"]] != job["text"]:
                job["text"], job["text_from"] = row[at["text"]], row[at["seq"]]
            if changed and row[at["source_url"]] is not None:
                job["source_url"], job["urls"]["source"] = row[at["source_url"]], row[at["source_key"]]
                self.file(row[at["source_key"]], number)
            self.leave(had, number)
            return "updated" if changed else "unchanged"

        def ended(self) -> Iterator[tuple]:
            for j in self.jobs:
                yield ("job", None, None, None, j["job_id"], j["made_by"], j["last"], j["sightings"], j["text_from"], j["source_url"], j["official_url"], j["posted_at"], j["rank"], j["classification"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, Group()
        waiting: list[tuple] = []  # the group's known jobs before its first sighting
        out: list[tuple] = []
        nothing = (None,) * 8

        def ended() -> Iterator[tuple]:
            yield from state.ended()
            for row in waiting:
                yield ("job", None, None, None, row[at["seq"]], None, None, 0, None, row[at["source_url"]], row[at["official_url"]], row[at["posted_at"]], row[at["rank"]], row[at["classification"]])

        def listed(column: pa.Array) -> list:
            """The column's values; numpy makes texts and keys much faster than ``to_pylist``."""
            if pa.types.is_temporal(column.type) or (column.null_count and pa.types.is_primitive(column.type)):
                return column.to_pylist()
            return column.to_numpy(zero_copy_only=False).tolist()

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return done

        for batch in batches:
            for row in zip(*map(listed, batch.columns)):
                if row[0] != group:
                    out.extend(ended())
                    group, state, waiting = row[0], Group(), []
                if row[at["known"]]:
                    waiting.append(row)
                    continue
                for job in waiting:
                    state.add(job, True)
                waiting = []
                met = state.find(row)
                if met is None:
                    number, outcome, tier = state.add(row, False), "new", None
                else:
                    tier, number = met
                    outcome = state.update(row, number)
                job = state.jobs[number]
                out.append(("row", row[at["seq"]], outcome, tier, job["job_id"], job["made_by"], *nothing))
                if len(out) >= 10_000:
                    yield flush()
        out.extend(ended())
        if out:
            yield flush()

    return run


def _link_keys(both: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """node, key: hashes of what ties rows that can meet; a clash of hashes only makes a group larger.

    Ids of several companies and their URLs are written, as they are most often few: then
    neither is found anew for each use of the keys, nor are all URLs shuffled to meet them.
    """
    hashed = lambda *c: F.when(F.greatest(*(F.col(x).isNull().cast("int") for x in c), F.lit(0)) == 0, F.xxhash64(*c))
    own = both.select("node", F.explode(F.array(*map(hashed, ("id_key", "requisition_key", "title_key")))).alias("key"))
    url = F.explode(F.array_distinct(F.array("official_key", "source_key", "other_key", "direct_key"))).alias("url")
    urls = both.select("node", "company", "id_key", url).where("url IS NOT NULL")
    ids = both.where("id_key IS NOT NULL").groupBy("id_key").agg(F.min("company").alias("low"), F.max("company").alias("high"), F.count_if(F.col("company").isNull()).alias("none"))
    mixed = cut(ids.where("low < high OR (none > 0 AND low IS NOT NULL)").select("id_key"))
    loose = cut(urls.join(mixed, "id_key", "left_semi").select("url").distinct())
    within = urls.where("company IS NOT NULL").select("node", hashed("company", "url").alias("key"))
    return own.where("key IS NOT NULL").unionByName(within).unionByName(urls.join(loose, "url", "left_semi").select("node", hashed("url").alias("key")))


def ingest(jobs: DataFrame, sightings: DataFrame, seq: str, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The sightings' outcomes and the jobs after the batch.

    ``jobs`` has job_id (unique, its order is the jobs' order) and the columns of
    ``JOB``, ``sightings`` has ``seq`` (unique, the order of the batch) and these.
    Outcomes: seq, outcome, tier, job_id (null for a job made in this batch) and made_by
    (the sighting that made it).  Jobs: job_id, made_by, the columns of ``JOB``,
    last_seq (the last sighting) and sightings (how many).
    """
    both = cut(_keyed(_told(jobs, True, "job_id").unionByName(_told(sightings, False, seq))))
    node = (F.col("seq") * 2 + F.when(F.col("known"), 0).otherwise(1)).alias("node")
    groups = linked_roots(_link_keys(both.withColumn("node", node), cut), cut)
    sent = both.withColumn("node", node).join(groups, "node", "left").withColumn("fold_group", F.coalesce("root", "node")).select(_SENT)
    ordered = sent.repartition("fold_group").sortWithinPartitions("fold_group", F.desc("known"), "seq")
    done = cut(ordered.mapInArrow(_fold(), _OUT))
    outcomes = done.where("kind = 'row'").select("seq", "outcome", "tier", "job_id", "made_by")
    after = done.where("kind = 'job'").drop("kind", "seq", "outcome", "tier").withColumnRenamed("sightings", "n_sightings")
    own = ["source", "source_job_id", "company", "requisition_id", "title", "location", "other_url"]
    old = jobs.select(F.col("job_id"), *own, F.col("description").alias("old_text"))
    new = sightings.select(F.col(seq).cast("long").alias("made_by"), *own, F.lit(None).cast("string").alias("old_text"))
    texts = sightings.select(F.col(seq).cast("long").alias("text_from"), "description")
    confidence = F.element_at(F.array(*(F.lit(c) for c in dates.CONFIDENCE)), F.col("rank") + 1).alias("confidence")
    kept = ["job_id", "made_by", *own, "old_text", "text_from", "official_url", "source_url", "posted_at", "rank", "classification", "last_seq", "n_sightings"]
    state = after.where("made_by IS NULL").join(old, "job_id").select(kept).unionByName(after.where("made_by IS NOT NULL").join(new, "made_by").select(kept))
    described = state.join(texts, "text_from", "left").withColumn("description", F.when(F.col("text_from").isNull(), F.col("old_text")).otherwise(F.col("description")))
    return outcomes, described.select("job_id", "made_by", *[c if c != "confidence" else confidence for c in JOB], "last_seq", F.col("n_sightings").alias("sightings"))


#: The five URL columns of a job, in the order in which they are looked at.
URL_COLUMNS = ["official_url", "official_apply_url", "official_job_url", "source_url", "url"]
#: Sources whose postings are read from public pages.
PAGE_SOURCES = ["icims", "successfactors"]
OFFICIAL = "VERIFIED_OFFICIAL_AT_LAST_CHECK"
PROMOTED_REASON = "Read from an official source and matched the engineering internship/co-op role filter."


def promote(jobs: DataFrame, sightings: DataFrame, now: Column) -> DataFrame:
    """The jobs, with the provenance of the direct sightings that name one of their URLs.

    ``sightings``: seq, company, apply_url, ats_type, ats_tenant, source_job_id,
    requisition_id.  All of them look at the jobs as they are before the batch; of the
    sightings of one job the last one's values stay.  Jobs without one are unchanged.
    """
    met = first_with_any_url(sightings, "seq", "company", F.col("apply_url"), jobs, "job_id", URL_COLUMNS, keys.canonical_url)
    told = ["seq", "apply_url", "ats_type", "ats_tenant", "source_job_id", "requisition_id"]
    last = met.join(sightings.select(told), "seq").groupBy("match_id").agg(F.max_by(F.struct(*told), "seq").alias("s"))
    joined = jobs.join(last, F.col("job_id") == F.col("match_id"), "left")
    hit = F.col("s").isNotNull()
    method = F.concat(F.col("s.ats_type"), F.when(F.col("s.ats_type").isin(PAGE_SOURCES), "-public-job-page").otherwise("-board-api"))
    values = {
        "source": F.col("s.ats_type"), "source_job_id": F.col("s.source_job_id"), "requisition_id": F.coalesce("s.requisition_id", jobs.requisition_id),
        "source_url": F.col("s.apply_url"), "source_listing_url": F.lit(None), "official_url": F.col("s.apply_url"), "original_url": F.col("s.apply_url"),
        "verification_status": F.lit(OFFICIAL), "reason_code": F.lit("OFFICIAL_ATS_BOARD"), "verification_method": method,
        "verification_reason": F.concat(F.lit("Read directly from the official "), F.col("s.ats_type"), F.lit(" job source.")), "last_verified_at": now,
        "ats_type": F.col("s.ats_type"), "ats_tenant": F.col("s.ats_tenant"), "classification": F.lit("QUALIFYING_INTERNSHIP"),
        "classification_reason": F.lit(PROMOTED_REASON), "active_feed": F.lit(True),
    }
    old = lambda c: jobs[c] if c in jobs.columns else F.lit(None)
    kept = [jobs[c] for c in jobs.columns if c not in values]
    return joined.select(*kept, *(F.when(hit, v).otherwise(old(c)).alias(c) for c, v in values.items()))
