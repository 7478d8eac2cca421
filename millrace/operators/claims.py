"""Claims against evidence: which sentences say what no approved fact supports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cut = Callable[[DataFrame], DataFrame]
# The beginnings by which words of one meaning are known.
STEMS = (
    ("acquir", "acquisition"), ("acquisition", "acquisition"), ("diagnos", "diagnose"), ("measur", "measure"), ("reliab", "reliability"),
    ("sampl", "sample"), ("stabil", "stability"), ("test", "test"),
)


def concepts(text: Column) -> Column:
    """The distinct concepts of a text: words of two signs or more, without a plural's end, by their stem."""

    def concept(word: Column) -> Column:
        one = F.when(F.endswith(word, F.lit("s")), F.left(word, F.length(word) - 1)).otherwise(word)
        known = F.lit(None).cast("string")
        for start, name in reversed(STEMS):
            known = F.when(F.startswith(word, F.lit(start)), name).otherwise(known)
        return F.coalesce(known, one)

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9+#]+"), lambda w: F.length(w) > 1)
    return F.array_distinct(F.transform(words, concept))


def sentences(text: Column) -> Column:
    """A text's sentences: parted by blanks behind a full stop, question or exclamation mark; empty ones go."""
    return F.filter(F.split(F.regexp_replace(text, "([.!?])[ \\t\\n\\x0b\\f\\r]+", "$1\u0001"), "\u0001"), lambda s: s != "")


def plain(text: Column) -> Column:
    """Words of letters, digits, + and #, with single blanks between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9+#]+", " "))


def covering(texts: DataFrame, text_id: list[str], words: str, phrases: DataFrame, phrase: str, parts: str, cut: Cut) -> DataFrame:
    """text_id, phrase: pairs where the text's array ``words`` has all of the phrase's ``parts`` (relational division).

    A phrase is filed under the part that the fewest texts have, so it meets only
    those texts, and is compared with their arrays, which come along: texts should be
    short.  A phrase without parts, or with one that no text has, covers nothing.
    ``text_id`` must be unique.
    """
    needed = cut(phrases.select(F.col(phrase).alias("phrase"), F.col(parts).alias("parts")).where("size(parts) > 0").dropDuplicates(["phrase"]))
    each = needed.select("phrase", F.explode("parts").alias("w"), F.size("parts").alias("k"))
    held = texts.select(F.explode_outer(F.array_distinct(words)).alias("w")).join(each.select("w").distinct(), "w", "left_semi")
    often = held.groupBy("w").agg(F.count("*").alias("n"))
    rarest = each.join(often, "w").groupBy("phrase", "k").agg(F.count("*").alias("found"), F.min(F.struct("n", "w")).alias("best")).where("found = k")
    filed = cut(rarest.select("phrase", F.col("best.w").alias("w")).join(needed, "phrase"))
    own = texts.select(*text_id, F.col(words).alias("words"), F.explode_outer(F.array_distinct(words)).alias("w"))
    return own.join(filed, "w").where(F.size(F.array_except("parts", "words")) == 0).select(*text_id, F.col("phrase").alias(phrase))


def unsupported_claims(sources: DataFrame, phrases: DataFrame, facts: DataFrame, cut: Cut) -> DataFrame:
    """section, sentence, phrase: what candidates' sentences (section, text, context) claim without a fact (fact_id, text).

    A phrase is supported if one fact has all its concepts.  Only texts of the context
    ``candidate`` make claims; a sentence counts once in its section.
    """
    wanted = phrases.select("phrase").distinct().withColumn("parts", concepts(F.col("phrase")))
    known = cut(facts.select("fact_id", concepts(F.col("text")).alias("words")))
    supported = covering(known, ["fact_id"], "words", wanted, "phrase", "parts", cut).select("phrase").distinct()
    lacking = wanted.join(supported, "phrase", "left_anti")
    said = sources.where("context = 'candidate'").select("section", F.explode_outer(F.array_distinct(F.transform(sentences(F.col("text")), lambda s: F.trim(s)))).alias("sentence"))
    said = cut(said.where("sentence IS NOT NULL").withColumn("words", concepts(F.col("sentence"))))
    return covering(said, ["section", "sentence"], "words", lacking, "phrase", "parts", cut).distinct()  # rows of one section may share sentences


def facts_without(facts: DataFrame, phrases: DataFrame, cut: Cut) -> DataFrame:
    """The facts (fact_id, text) that have none of the phrases' meanings."""
    wanted = phrases.select("phrase").distinct().withColumn("parts", concepts(F.col("phrase")))
    known = cut(facts.select("fact_id", concepts(F.col("text")).alias("words")))
    meant = covering(known, ["fact_id"], "words", wanted, "phrase", "parts", cut).select("fact_id").distinct()
    return facts.join(meant, "fact_id", "left_anti")


def named_phrases(texts: DataFrame, phrases: DataFrame, cut: Cut) -> DataFrame:
    """text_id, phrase: texts (text_id, text) that have the phrase's words in a row; phrases of one sign are none.

    Phrases are filed under their first two words (or their only one), and meet the
    texts' neighbouring words, without the texts; only phrases of more words are then
    compared with the texts that have their beginning.  ``text_id`` must be unique.
    """
    wanted = phrases.select("phrase").distinct().withColumn("plain", plain(F.col("phrase"))).where("length(plain) >= 2")
    wanted = cut(wanted.withColumns({"head": F.substring_index("plain", " ", 2), "k": F.size(F.split("plain", " "))}))
    own = cut(texts.select("text_id", plain(F.col("text")).alias("text")))
    words = F.split("text", " ")
    heads = F.zip_with(words, F.slice(words, 2, F.length("text") + 1), lambda a, b: F.concat(a, F.lit(" "), b))
    if not wanted.where("k = 1").isEmpty():
        heads = F.concat(heads, words)
    met = cut(own.select("text_id", F.explode_outer(F.array_distinct(heads)).alias("head")).join(wanted, "head").select("text_id", "phrase", "plain", "k"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    longer = met.where("k > 2").join(own, "text_id").where(F.contains(pad("text"), pad("plain")))
    return met.where("k <= 2").select("text_id", "phrase").unionByName(longer.select("text_id", "phrase"))


def _token(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(word), "'s$", ""), "[^a-z0-9]", "")


def claim_tokens(sentence: Column) -> Column:
    """What a sentence names: words with digits, and capitalised ones of three letters or more but the first."""
    words = F.split(sentence, "[ \\t\\n\\x0b\\f\\r]+")
    bare = F.transform(words, lambda w, i: F.struct(F.regexp_replace(w, "^[^a-zA-Z0-9]+|[^a-zA-Z0-9]+$", "").alias("w"), i.alias("i")))
    named = F.filter(bare, lambda x: x.w.rlike("[0-9]") | ((x.i > 0) & x.w.rlike("^[A-Z]") & (F.length(x.w) > 2)))
    return F.array_distinct(F.transform(named, lambda x: _token(x.w)))


def grounded(texts: DataFrame, corpus: DataFrame, cut: Cut) -> DataFrame:
    """text_id, sentence_no, sentence, kept: sentences (of text_id, text) that name nothing, or something that the corpus (text) has."""
    words = corpus.select(F.explode(F.split(F.lower("text"), "[^a-z0-9+.#]+")).alias("w")).where("length(w) > 2").select(_token(F.col("w")).alias("token")).distinct()
    said = cut(texts.select("text_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence")).withColumn("tokens", claim_tokens(F.col("sentence"))))
    named = said.select("text_id", "sentence_no", F.explode("tokens").alias("token"))
    met = named.join(words, "token", "left_semi").select("text_id", "sentence_no").distinct().withColumn("met", F.lit(True))
    kept = (F.size("tokens") == 0) | F.coalesce("met", F.lit(False))
    return said.join(met, ["text_id", "sentence_no"], "left").select("text_id", "sentence_no", "sentence", kept.alias("kept"))
