"""Identity keys: canonical URLs, title, location, company and event keys (Column expressions)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track a visit.
TRACKING_PARAMETERS = (
    "utm_[a-z]+|gh_src|lever-source|lever-origin|lever-via|ref|source|src|fbclid|gclid|msclkid|mc_cid|mc_eid|trk|trackingid|_ga"
)
#: Legal suffixes that company keys leave out.
LEGAL_SUFFIXES = "inc|llc|ltd|corp|corporation|company|co|plc|gmbh|holdings|group|technologies|technology|labs"

URL = r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(url: Column) -> Column:
    """One key for all campaign links of a page.

    Tracking parameters, the fragment, a leading ``www.`` and trailing slashes go;
    the scheme becomes https and the host lower case.  Text that isn't a URL is
    kept trimmed; empty text and null give null.
    """
    kept = F.filter(
        F.split(F.regexp_extract(url, URL, 4), "&"),
        lambda p: (F.length(p) > 0) & ~F.regexp_like(F.split(p, "=")[0], F.lit(f"(?i)^({TRACKING_PARAMETERS})$")),
    )
    host = F.regexp_replace(F.lower(F.regexp_extract(url, URL, 2)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, URL, 3), "/+$", "")
    query = F.array_join(kept, "&")
    whole = F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.regexp_like(url, F.lit(URL)), whole).otherwise(F.nullif(F.trim(url), F.lit("")))


def host(url: Column) -> Column:
    """Lower-case host without ``www.``; null if there is none."""
    return F.nullif(_host(url), F.lit(""))


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, URL, 2)), r"^www\.|:\d+$", "")


def host_in(url: Column, hosts: list[str]) -> Column:
    """Whether the host is one of ``hosts`` or below one."""
    below = "|".join(map(re.escape, hosts)) or "(?!)"
    return F.coalesce(F.regexp_like(_host(url), F.lit(rf"(?:^|\.)(?:{below})\z")), F.lit(False))


def secure_url(url: Column) -> Column:
    """http becomes https; other schemes give null."""
    return F.when(url.rlike("(?i)^https?://"), F.regexp_replace(url, "(?i)^http:", "https:"))


def title_key(title: Column) -> Column:
    """Letters and digits alone; words such as "intern" stay."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")


def location_key(location: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(location, F.lit(""))), "[^a-z0-9]+", " "))


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def company_key(name: Column) -> Column:
    """Letters and digits of a company's name without legal suffixes."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), rf"\b({LEGAL_SUFFIXES})\b\.?", " "), "[^a-z0-9]+", "")


def event_key(identity: Column) -> Column:
    """The first 40 hexadecimal digits of the identity's SHA-256."""
    return F.substring(F.sha2(identity, 256), 1, 40)


def slug_candidates(name: Column) -> Column:
    """Board slugs that a company's name suggests, best first: squashed, hyphenated, first long word."""
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), rf"\b({LEGAL_SUFFIXES})\b", " "), "&", " and "))
    squashed = F.regexp_replace(cleaned, "[^a-z0-9]+", "")
    hyphenated = F.regexp_replace(F.regexp_replace(cleaned, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    first = F.split(cleaned, r"\s+")[0]
    found = F.array(squashed, hyphenated, F.when(F.length(first) >= 5, first))
    return F.array_distinct(F.filter(found, lambda s: F.length(s) >= 3))


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the text's UTF-16 units, as eight hexadecimal digits."""
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(text, "utf-16be")), "(....)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    value = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(0x01000193).cast("long"), F.lit(1 << 32)))
    return F.lpad(F.lower(F.hex(value)), 8, "0")
