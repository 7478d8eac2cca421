"""Disciplines and target roles of postings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import disciplines
from .base import Tables, query

_WORDS = [(n, tag, w) for n, (tag, words) in enumerate(disciplines.DISCIPLINES.items()) for w in words]
#: Titles by doc_id: the words of students' roles and their near misses, in several cases; {} is one of the vocabulary's words.
_TITLES = ["{} Intern", "Senior {}", "{} INTERNSHIPS 2026", "International {}", "{} Co-op", "{} coops", "Undergrad, {}", "Undergraduates in {}", "Internal tools", "Summer Intern", "{}"]
_TITLE_SQL = f"""
v(n, tag, w) AS (VALUES {', '.join(f"({n}, '{tag}', '{w}')" for n, tag, w in _WORDS)}),
f AS (SELECT list(w ORDER BY n, w) AS words FROM v),
t AS (SELECT doc_id, text, replace([{', '.join(f"'{x}'" for x in _TITLES)}][CAST(doc_id % {len(_TITLES)} AS INT) + 1], '{{}}', CASE WHEN doc_id % 3 = 0 THEN upper(words[CAST(doc_id % {len(_WORDS)} AS INT) + 1]) ELSE words[CAST(doc_id % {len(_WORDS)} AS INT) + 1] END) AS title FROM documents, f),
d AS (SELECT doc_id, title, lower(title || ' ' || coalesce(text, '')) AS said FROM t),
g AS (SELECT DISTINCT doc_id, n, tag FROM d JOIN v ON contains(said, w))
"""


@query("target_roles", f"""
WITH {_TITLE_SQL}, a AS (SELECT doc_id, string_agg(tag, ',' ORDER BY n) AS tags FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.tags, '') AS tags, a.tags IS NOT NULL AND regexp_matches(title, '(?i)\\b(intern(ship)?s?|co-?ops?|undergrad(uate)?)\\b') AS target FROM d LEFT JOIN a USING (doc_id)
""")
def target_roles(t: Tables) -> DataFrame:
    """Every document as a description, with titles that go through the whole vocabulary."""
    words = F.array(*(F.lit(w) for _, _, w in sorted(_WORDS, key=lambda x: (x[0], x[2]))))
    word = words[(F.col("doc_id") % len(_WORDS)).cast("int")]
    form = F.array(*map(F.lit, _TITLES))[(F.col("doc_id") % len(_TITLES)).cast("int")]
    title = F.replace(form, F.lit("{}"), F.when(F.col("doc_id") % 3 == 0, F.upper(word)).otherwise(word))
    rows = t.documents.select("doc_id", title.alias("title"), "text")
    found = disciplines.with_roles(rows, F.col("title"), F.col("text"), "found", "target")
    return found.select("doc_id", F.array_join("found", ",").alias("tags"), "target")
