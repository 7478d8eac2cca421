"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path`` together with the literal
tokens that every matching URL must hold.  Token frequencies are counted over
all URLs; each rule is filed under its rarest token, URL tokens fetch candidate
rules by an equi-join, and only the fetched rules run their expressions.  A rule
without a literal token is filed under the empty token, which every URL has.

Everything is DataFrame functions: one pass to count tokens, one to judge, and
one shuffle of a row per page (the partial aggregate folds a page's tokens
before it).  The rules side is joined without a hint, so Spark broadcasts it
only while it is under its own size threshold and sort-merges beyond.

Defined results: a null URL, or one without ``://``, has empty host and path, no
rule and the default verdict; repeated pages are judged separately; an empty
table gives no rows; extra columns are ignored.  Among list rules the longest
wins, equal lengths by rule text; pattern rules count only where no list rule
fits, and there a block beats an allow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import lower_ascii, read

SPLIT = r"[^0-9a-z]+"


@dataclass(frozen=True)
class UrlRule:
    """verdict, rule text, expression over host+path, tokens it needs, list rule or pattern."""

    verdict: str
    rule: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool = True


def list_rule(verdict: str, host: str, path: str) -> UrlRule:
    """A rule for a host with its subdomains and a path prefix."""
    text = host + path
    tokens = [t for t in re.split(SPLIT, text.lower()) if t]
    if path and re.search(r"[0-9a-zA-Z]$", path):
        tokens.pop()  # the prefix may end within a longer token
    end = re.escape(path) if path else "(?:/|$)"
    return UrlRule(verdict, text, rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{end}", tuple(tokens))


def pattern_rule(verdict: str, word: str) -> UrlRule:
    """A rule for a literal token in a host label."""
    return UrlRule(verdict, f"~{word}", rf"(?s)^[^/]*(?<![0-9a-z]){word}(?![0-9a-z])[^/]*(?:/|$)", (word,), False)


#: The rules of the query's contract, and pattern rules for hosts that sell or track.
LISTED = (
    list_rule("block", "net", "/"),
    list_rule("allow", "example.net", "/en/"),
    list_rule("block", "example.com", "/de/"),
    list_rule("allow", "org", "/fr/"),
)
PATTERNS = tuple(pattern_rule("block", w) for w in ("adult", "ads", "bets", "casino", "pills", "poker", "porn", "spam", "xxx"))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: tuple[UrlRule, ...]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).alias("rule_no"),
            F.lit(r.verdict).alias("rule_verdict"),
            F.lit(r.rule).alias("rule"),
            F.lit(r.regex).alias("regex"),
            F.array(*[F.lit(t) for t in r.tokens or ("",)]).alias("literals"),
            F.lit(r.listed).alias("listed"),
        )
        for i, r in enumerate(rules)
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def index_rules(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """File each rule under the one of its literals that fewest rows of ``tokens`` hold."""
    literals = rules.select("rule_no", F.explode("literals").alias("token"))
    counts = tokens.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    order = Window.partitionBy("rule_no").orderBy(F.coalesce("count", F.lit(0)), "token")
    rarest = literals.join(counts, "token", "left").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return rarest.select("rule_no", "token").join(rules.drop("literals"), "rule_no")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern for every row of ``pages``."""
    parts = pages.select(
        "page_id", F.monotonically_increasing_id().alias("row_no"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    target = F.concat("host", "path")
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split(lower_ascii(target), SPLIT)))
    exploded = parts.withColumn("token", F.explode(tokens))
    filed = index_rules(rules, exploded.select("token"))
    hit = F.when(
        F.regexp_like(F.concat("host", "path"), F.col("regex")),
        F.struct(
            F.col("listed").alias("listed"),
            F.when(F.col("listed"), F.length("rule")).otherwise(F.when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("rank"),
            F.col("rule").alias("rule"),
            F.col("rule_verdict").alias("rule_verdict"),
        ),
    )
    best = exploded.join(filed, "token", "left").groupBy("row_no", "page_id", "host", "path").agg(F.max(hit).alias("best"))
    return best.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.listed"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.when(~F.col("best.listed"), F.col("best.rule")).alias("pattern"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), rules_frame(spark, LISTED + PATTERNS))


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
    (SELECT min(w) FROM unnest(['adult','ads','bets','casino','pills','poker','porn','spam','xxx']) t(w)
      WHERE regexp_matches(host, '(^|[^0-9a-z])' || w || '($|[^0-9a-z])')) AS first_word,
    (SELECT max(w) FROM unnest(['adult','ads','bets','casino','pills','poker','porn','spam','xxx']) t(w)
      WHERE regexp_matches(host, '(^|[^0-9a-z])' || w || '($|[^0-9a-z])')) AS last_word
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN first_word IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN '~' || last_word END AS pattern
FROM judged
"""
