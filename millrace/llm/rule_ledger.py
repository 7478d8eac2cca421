"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document in one map pass; the ledger keeps the
measurements and one bit per failed rule.  Versioned policies are masks over
those bits.  The ledger is written once, with its version; a policy, a change of
policy or an ablation reads only the written ledger: a document
passes a policy when ``bits & mask = 0``, and an ablation of rule r passes where
``bits & (mask & ~r) = 0``.  Ablations aggregate with partial sums, one row per
rule, whatever the corpus size.

Defined results: null and empty texts have no words, so they fail the base rule;
repeated rows are judged separately; an empty table gives an empty ledger; other
columns are carried or ignored, and names of the ledger win.  Very long texts
are read whole; the measurements of a text take memory in proportion to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, ship

WINDOW = 5
SPACE = re.compile(r"[\x20\x09-\x0D]")
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_bang long"
NAMES = [m.split()[0] for m in MEASURES.split(", ")]


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words in windows found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    base = len(number)
    code, size = ids[:n].copy(), base
    for k in range(1, window):
        if size > (1 << 62) // base:  # re-number before the product could overflow
            code = np.unique(code, return_inverse=True)[1]
            size = n
        code = code * base + ids[k : n + k]
        size *= base
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    hit = (counts > 1)[inverse]
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[window : n + window] -= hit
    return int((np.cumsum(edge)[: len(words)] > 0).sum())


def measure(text: str | None) -> tuple:
    """The measurements of one whole text, in the order of MEASURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    # code points: all bytes but the continuation bytes of UTF-8
    letters = sum(map(len, words)) if text.isascii() else len(text) - len(SPACE.findall(text))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), letters, symbols, len(lines) - len(set(lines)), repeat_words(words), len(lines), upper, raw.count(b"!")


def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=NAMES, dtype="int64")


#: Bit of each rule, with the condition under which a document fails it.
RULES: dict[str, tuple[int, str]] = {
    "too_few_words": (1, "n_words < 10"),
    "repeated_windows": (2, "100 * n_repeat_words > 20 * n_words"),
    "symbol_noise": (4, "10 * n_symbols > n_words"),
    "repeated_lines": (8, "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    "shouting": (16, "2 * n_upper > word_chars"),
    "exclamations": (32, "4 * n_bang > n_words"),
    "odd_word_length": (64, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
}
BASE_MASK = 1 | 2
#: Changes with RULES: bits of another version mean other rules.
LEDGER_VERSION = 1
#: A policy is a version's mask over the rule bits.
POLICIES: dict[str, int] = {"base": BASE_MASK, "v1": BASE_MASK | 4 | 16 | 32, "v2": 127}


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: kept columns, measurements and failure bits."""
    ship(docs.sparkSession)
    each = F.pandas_udf(measured, MEASURES)
    bits = F.lit(0)
    for bit, fails in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(fails), bit).otherwise(0))
    return docs.select(*keep, each("text").alias("m")).select(*keep, "m.*").withColumn("fail_bits", bits)


def write_ledger(docs: DataFrame, scratch: Scratch, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger of ``docs``, written with its version and read back."""
    return scratch.table(ledger(docs, keep).withColumn("ledger_version", F.lit(LEDGER_VERSION)), "ledger")


def current(rows: DataFrame) -> DataFrame:
    """A read ledger; fails on rows of another version of the rules."""
    known = F.col("ledger_version") == LEDGER_VERSION
    return rows.withColumn("fail_bits", F.when(known, F.col("fail_bits")).otherwise(F.raise_error(F.lit("a ledger of other rules")).cast("int")))


def passes(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return rows.withColumn("kept", passes(POLICIES[version]))


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, kept without it.

    One aggregation over the ledger; its result has as many rows as the policy has rules.
    """
    mask = POLICIES[version]
    names = [n for n, (bit, _) in RULES.items() if bit & mask]
    aggs = [F.count("*").alias("n"), F.count_if(passes(mask)).alias("kept")]
    for n in names:
        bit = RULES[n][0]
        aggs += [
            F.count_if(F.col("fail_bits").bitwiseAND(F.lit(bit)) != 0).alias(f"fails_{n}"),
            F.count_if(F.col("fail_bits").bitwiseAND(F.lit(mask)) == bit).alias(f"alone_{n}"),
        ]
    rows_out = [F.struct(F.lit(n).alias("rule"), F.col(f"fails_{n}").alias("n_failing"), F.col(f"alone_{n}").alias("n_only_this"), (F.col("kept") + F.col(f"alone_{n}")).alias("n_kept_without")) for n in names]
    return rows.agg(*aggs).select("n", "kept", F.inline(F.array(*rows_out)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_ledger(read(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "rule-ledger"))
    rows = apply_policy(current(written), "v1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(BASE_MASK)).alias("base_failed"), "kept", "fail_bits",
    )


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ablations of each policy over the written ledger of all documents."""
    rows = current(write_ledger(read(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "rule-ledger")))
    found = [ablations(rows, version).select(F.lit(version).alias("policy"), "*") for version in POLICIES]
    return found[0].unionByName(found[1]).unionByName(found[2])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (
  SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
keyed AS (SELECT r, i, array_to_string(words[i:i+4], chr(10)) AS g FROM grams),
hits AS (
  SELECT r, i FROM keyed QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM hits) GROUP BY r),
m AS (
  SELECT w.doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    length(text) - length(replace(text, '!', '')) AS n_bang, len(lines) AS n_lines
  FROM w LEFT JOIN covered c ON c.r = w.r),
f AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) | (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    | (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) | (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    | (CASE WHEN 2 * n_upper > word_chars THEN 16 ELSE 0 END) | (CASE WHEN 4 * n_bang > n_words THEN 32 ELSE 0 END)
    | (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 64 ELSE 0 END) AS INTEGER) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (fail_bits & 52) = 0 AS kept, fail_bits
FROM f
"""

ABLATION_ORACLE = ORACLE[: ORACLE.rindex("SELECT doc_id")].rstrip() + r""",
rules AS (SELECT * FROM (VALUES ('too_few_words', 1), ('repeated_windows', 2), ('symbol_noise', 4), ('repeated_lines', 8), ('shouting', 16), ('exclamations', 32), ('odd_word_length', 64)) r(rule, bit)),
policies AS (SELECT * FROM (VALUES ('base', 3), ('v1', 55), ('v2', 127)) p(policy, mask))
SELECT policy, rule, (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM f WHERE fail_bits & mask = 0) AS kept,
  (SELECT count(*) FROM f WHERE fail_bits & bit <> 0) AS n_failing, (SELECT count(*) FROM f WHERE fail_bits & mask = bit) AS n_only_this,
  (SELECT count(*) FROM f WHERE fail_bits & (mask & ~bit) = 0) AS n_kept_without
FROM policies, rules WHERE mask & bit <> 0
"""
