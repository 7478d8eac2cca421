"""Claims in documents against the facts of conversations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims
from ..operators.tables import Passing
from .base import Tables, query

_CONCEPTS = """list_distinct(list_transform(list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9+#]+'), lambda w: length(w) > 1), lambda w: CASE
  WHEN regexp_matches(w, '^(acquir|acquisition)') THEN 'acquisition' WHEN regexp_matches(w, '^diagnos') THEN 'diagnose' WHEN regexp_matches(w, '^measur') THEN 'measure' WHEN regexp_matches(w, '^reliab') THEN 'reliability'
  WHEN regexp_matches(w, '^sampl') THEN 'sample' WHEN regexp_matches(w, '^stabil') THEN 'stability' WHEN regexp_matches(w, '^test') THEN 'test' ELSE regexp_replace(w, 's$', '') END))"""
_BLANK = "[ \\t\\n\\x0b\\f\\r]+"
_SENTENCES = f"list_filter(string_split(regexp_replace({{c}}, '([.!?]){_BLANK}', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
#: Every two neighbouring words of the benchmark's items, some with words of a stem, are qualifications.
_PHRASES = """
b AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), i AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM b),
p AS (SELECT DISTINCT CASE (item_id + i) % 40 WHEN 0 THEN w[i] || ' testing' WHEN 1 THEN 'reliable ' || w[i + 1] ELSE w[i] || '-' || w[i + 1] END AS phrase FROM i)"""
_NEEDED = f"q AS (SELECT phrase, {_CONCEPTS.format(c='phrase')} AS parts FROM p), n AS (SELECT phrase, len(parts) AS k, unnest(parts) AS w FROM q)"


def _phrases(t: Tables) -> DataFrame:
    words = t.benchmark.select("item_id", F.split("text", " ").alias("w"))
    at = words.select("item_id", F.posexplode(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("i", "a"), "w").withColumn("b", F.col("w")[F.col("i") + 1])
    k = (F.col("item_id") + F.col("i") + 1) % 40
    phrase = F.when(k == 0, F.concat("a", F.lit(" testing"))).when(k == 1, F.concat(F.lit("reliable "), "b")).otherwise(F.concat_ws("-", "a", "b"))
    return at.select(phrase.alias("phrase")).distinct()


def _facts(t: Tables) -> DataFrame:
    return t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("fact_id"), F.coalesce("text", F.lit("")).alias("text"))


@query("unsupported_claims", f"""
WITH {_PHRASES}, {_NEEDED},
f AS (SELECT conv_id || '-' || turn AS fact_id, unnest({_CONCEPTS.format(c='text')}) AS w FROM conversations),
ok AS (SELECT DISTINCT phrase FROM (SELECT phrase, fact_id FROM n JOIN f USING (w) GROUP BY phrase, fact_id, k HAVING count(*) = k)),
s AS (SELECT DISTINCT doc_id, trim(sentence) AS sentence FROM (SELECT doc_id, unnest({_SENTENCES.format(c='text')}) AS sentence FROM documents WHERE doc_id % 4 < 3)),
c AS (SELECT doc_id, sentence, unnest({_CONCEPTS.format(c='sentence')}) AS w FROM s)
SELECT doc_id, md5(sentence) AS sentence, phrase FROM n JOIN c USING (w) WHERE phrase NOT IN (SELECT phrase FROM ok) GROUP BY doc_id, sentence, phrase, k HAVING count(*) = k
""")
def unsupported_claims(t: Tables) -> DataFrame:
    """Sentences of the documents that candidates wrote (three in four) with a qualification that no turn supports."""
    context = F.when(F.col("doc_id") % 4 < 3, "candidate").otherwise("job_requirement")
    sources = t.documents.select(F.col("doc_id").alias("section"), "text", context.alias("context"))
    out = claims.unsupported_claims(sources, _phrases(t), _facts(t), Passing(t.spark, "claims"))
    return out.select(F.col("section").alias("doc_id"), F.md5("sentence").alias("sentence"), "phrase")


@query("facts_left", f"""
WITH {_PHRASES}, {_NEEDED}, f AS (SELECT conv_id || '-' || turn AS fact_id, unnest({_CONCEPTS.format(c='text')}) AS w FROM conversations),
bad AS (SELECT fact_id FROM n JOIN f USING (w) GROUP BY phrase, fact_id, k HAVING count(*) = k)
SELECT conv_id || '-' || turn AS fact_id FROM conversations WHERE conv_id || '-' || turn NOT IN (SELECT fact_id FROM bad)
""")
def facts_left(t: Tables) -> DataFrame:
    """Turns that have none of the qualifications' meanings."""
    return claims.facts_without(_facts(t), _phrases(t), Passing(t.spark, "claims")).select("fact_id")


@query("named_phrases", f"""
WITH {_PHRASES}, q AS (SELECT phrase, trim(regexp_replace(lower(phrase), '[^a-z0-9+#]+', ' ', 'g')) AS plain FROM p),
d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9+#]+', ' ', 'g')) || ' ' AS text FROM documents)
SELECT doc_id, phrase FROM d JOIN q ON length(plain) >= 2 AND contains(d.text, ' ' || plain || ' ')
""")
def named_phrases(t: Tables) -> DataFrame:
    """Documents with a qualification word for word."""
    texts = t.documents.select(F.col("doc_id").alias("text_id"), "text")
    return claims.named_phrases(texts, _phrases(t), Passing(t.spark, "claims")).withColumnRenamed("text_id", "doc_id")


_TOKEN = "regexp_replace(regexp_replace(lower({w}), '''s$', ''), '[^a-z0-9]', '', 'g')"


@query("grounded_sentences", f"""
WITH k AS (SELECT DISTINCT {_TOKEN.format(w='w')} AS token FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9+.#]+')) AS w FROM conversations) WHERE length(w) > 2),
s AS (SELECT doc_id, unnest({_SENTENCES.format(c='text')}) AS sentence, generate_subscripts({_SENTENCES.format(c='text')}, 1) AS n FROM documents),
w AS (SELECT doc_id, n, i, regexp_replace(words[i], '^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$', '', 'g') AS w FROM (SELECT doc_id, n, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT doc_id, n, string_split_regex(sentence, '{_BLANK}') AS words FROM s))),
c AS (SELECT doc_id, n, {_TOKEN.format(w='w')} AS token FROM w WHERE regexp_matches(w, '[0-9]') OR (i > 1 AND regexp_matches(w, '^[A-Z]') AND length(w) > 2)),
g AS (SELECT doc_id, n, bool_or(token IN (SELECT token FROM k)) AS kept FROM c GROUP BY doc_id, n)
SELECT doc_id, count(*) FILTER (coalesce(kept, true)) AS kept, count(*) FILTER (NOT coalesce(kept, true)) AS rejected FROM s LEFT JOIN g USING (doc_id, n) GROUP BY doc_id
""")
def grounded_sentences(t: Tables) -> DataFrame:
    """How many sentences of a document name nothing or something known, and how many only what isn't."""
    texts = t.documents.select(F.col("doc_id").alias("text_id"), "text")
    out = claims.grounded(texts, t.conversations.select("text"), Passing(t.spark, "claims"))
    return out.groupBy(F.col("text_id").alias("doc_id")).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"))
