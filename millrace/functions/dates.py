"""Posting dates, ages and retry times (Column expressions; clocks are always arguments)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of the units in relative dates.
UNIT_SECONDS = {
    "second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "m": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86400, "d": 86400,
    "week": 604800, "w": 604800, "month": 2592000, "mo": 2592000, "year": 31536000, "y": 31536000,
}
#: The forms of relative dates, and of those that mean the moment of reading.
RELATIVE = (
    r"(?i)(?:^|\s)(?:about\s+|over\s+|almost\s+|nearly\s+)?(\d+)\s*\+?\s*"
    r"(second|sec|minute|min|hour|hr|day|week|month|mo|year|s|m|h|d|w|y)s?\.?\s*ago\b"
)
JUST_NOW = r"\b(just\s+posted|just\s+now|moments?\s+ago|new\s+today)\b"
#: Ages beyond this many seconds are no dates.
LONGEST_AGO = 60_000_000_000
#: The confidences of a date, from the least, and the months' names.
CONFIDENCE = ("UNKNOWN", "DATE_ONLY", "RELATIVE_PARSED", "EXACT")
MONTH_NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))


def with_posted_at(rows: DataFrame, raw: Column, captured_at: Column, name: str) -> DataFrame:
    """``rows`` with ``posted_at`` as the column ``name``, computed once a row in compiled code.

    The forms that the text may have are one projection, the choice among them the
    next, so no field asked for repeats the patterns.
    """
    forms, chosen = "posting_forms", f"`{name}`"
    while forms in rows.columns:
        forms += "_"
    return rows.withColumn(forms, _forms(raw, captured_at)).withColumn(name, _chosen(F.col(forms))).select(*[f"`{c}`" for c in rows.columns if c != name], chosen)


def posted_at(raw: Column, captured_at: Column) -> Column:
    """Struct of instant, text and confidence of a source's posting date.

    Reads epochs of 10 to 13 digits, "N units ago", just now, yesterday and today,
    ISO date-times and dates, ``m/d/yyyy`` and ``Mon d, yyyy``; other text is kept
    with confidence UNKNOWN, and blank text is null.  ``with_posted_at`` is the faster form.
    """
    return let(_forms(raw, captured_at), _chosen)


def _forms(raw: Column, captured_at: Column) -> Column:
    """The instants that a text has by each form; only the first form that fits is parsed."""
    text = F.nullif(F.trim(raw), F.lit(""))
    low = F.lower(text)
    day = F.date_trunc("day", captured_at)
    number = text.try_cast("long")
    epoch = F.when(text.rlike(r"^\d{10,13}$"), F.timestamp_millis(F.when(number < 100_000_000_000, number * 1000).otherwise(number)))
    units = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    ago = F.try_multiply(F.when(low.contains("ago"), F.regexp_extract(text, RELATIVE, 1)).try_cast("long"), units[F.lower(F.regexp_extract(text, RELATIVE, 2))].cast("long"))
    ago = F.when(ago <= LONGEST_AGO, ago)
    relative = F.timestamp_seconds(F.unix_micros(captured_at) / 1_000_000 - ago)
    iso_time = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), text.try_cast("timestamp"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    us_pattern = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    us = F.when(text.rlike(us_pattern), _date(*(F.regexp_extract(text, us_pattern, g) for g in (3, 1, 2))))
    name_pattern = rf"(?i)^({'|'.join(MONTH_NAMES)})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})$"
    months = F.array(*[F.lit(m) for m in MONTH_NAMES])
    month = F.array_position(months, F.lower(F.regexp_extract(text, name_pattern, 1))).cast("string")
    named = F.when(text.rlike(name_pattern), _date(F.regexp_extract(text, name_pattern, 3), month, F.regexp_extract(text, name_pattern, 2)))
    just_now = low.rlike(JUST_NOW)
    dated = F.when(low.rlike(r"\byesterday\b"), day - F.expr("interval 1 day")).when(low.rlike(r"\btoday\b"), day)
    said = low.contains("ago") | low.contains("just") | low.contains("today")
    return F.struct(
        text.alias("text"), epoch.alias("epoch"), F.when(said, F.when(ago.isNotNull(), relative).when(just_now, captured_at)).alias("relative"),
        dated.alias("dated"), iso_time.alias("iso_time"), F.coalesce(iso, us, named).alias("written"),
    )


def _chosen(p: Column) -> Column:
    return F.struct(
        F.coalesce(p.epoch, p.relative, p.dated, p.iso_time, p.written).alias("posted_at"),
        p.text.alias("posted_text"),
        F.when(p.epoch.isNotNull(), "EXACT").when(p.relative.isNotNull(), "RELATIVE_PARSED").when(p.dated.isNotNull(), "DATE_ONLY")
        .when(p.iso_time.isNotNull(), "EXACT").when(p.written.isNotNull(), "DATE_ONLY").otherwise("UNKNOWN").alias("confidence"),
    )


def confidence_rank(confidence: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), confidence), F.lit(1)) - 1


def replaces(old_at: Column, old_confidence: Column, new_at: Column, new_confidence: Column) -> Column:
    """Whether a new posting date may overwrite the old one: only a strictly surer one may."""
    return new_at.isNotNull() & (old_at.isNull() | (confidence_rank(new_confidence) > confidence_rank(old_confidence)))


def age_label(at: Column, now: Column) -> Column:
    """``just now``, or the age in the largest whole unit; null for null."""
    seconds = (F.unix_micros(now) - F.unix_micros(at)) / 1_000_000
    out = F.when(seconds < 60, "just now")
    for name, size, below in (("minute", 60, 3600), ("hour", 3600, 86400), ("day", 86400, 604800), ("week", 604800, 2592000), ("month", 2592000, 31536000), ("year", 31536000, None)):
        n = F.floor(seconds / size)
        label = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        out = out.when(seconds < below, label) if below else out.when(seconds.isNotNull(), label)
    return out


def retry_minutes(attempts: Column, base: int = 10, top: int = 120, steps: int = 4) -> Column:
    """Exponential backoff with a ceiling."""
    return F.least(F.lit(top), F.lit(base) * F.pow(F.lit(2), F.least(attempts, F.lit(steps)))).cast("int")


def lag_minutes(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / 60_000_000)
