"""Which texts contain which phrases: many phrases of any length against many texts, by equi-joins on words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _grams(c: Column, most: int = GRAM) -> Column:
    """The distinct substrings of up to ``most`` letters, each found in one pass."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(f"(?=(.{{{n}}}))"), 1) for n in range(1, most + 1)))))


def phrase_candidates(texts: DataFrame, text_id: str, text: str, phrases: DataFrame, phrase: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """text_id, phrase: pairs where the text has a word that the phrase needs, all pairs that match among them.

    Texts and phrases are of words with single blanks between.  A phrase occurs only
    where its first word ends a word of the text, its last one starts one and those
    between are words of it (a single word may be anywhere in one).  The pieces of the
    phrases meet the vocabulary, not the texts: each piece is filed under its rarest
    gram among the vocabulary's words.  Of a phrase's pieces the one with the fewest
    texts then meets the texts' words; a phrase with a piece that no word has is
    dropped.  No text is moved and no key holds all phrases, unless all of them occur.
    """
    words = cut(texts.select(text_id, F.explode(F.array_distinct(F.split(text, " "))).alias("word")).where("word <> ''"))
    vocabulary = words.groupBy("word").agg(F.count("*").alias("df"))
    parts = phrases.select(F.col(phrase).alias("phrase")).where("phrase <> ''").distinct().withColumn("k", F.size(F.split("phrase", " ")))
    parts = parts.select("phrase", "k", F.posexplode(F.split("phrase", " ")).alias("i", "piece"))
    pieces = parts.select("piece").distinct()
    own = pieces.select("piece", F.explode(_grams(F.col("piece"))).alias("gram")).where(F.length("gram") == F.least(F.lit(GRAM), F.length("piece")))
    filed = vocabulary.select("word", "df", F.explode(_grams(F.col("word"))).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    filed = cut(filed)
    often = filed.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(often, "gram").groupBy("piece").agg(F.min(F.struct("n", "gram")).alias("g")).select("piece", F.col("g.gram").alias("gram"))
    met = rarest.join(filed, "gram").where(F.contains("word", "piece")).select("piece", "word", "df")
    fits = (
        F.when(F.col("k") == 1, True).when(F.col("i") == 0, F.endswith(F.col("word"), F.col("piece")))
        .when(F.col("i") == F.col("k") - 1, F.startswith(F.col("word"), F.col("piece"))).otherwise(F.col("word") == F.col("piece"))
    )
    placed = cut(parts.join(met, "piece").where(fits).select("phrase", "k", "i", "word", "df"))
    costs = placed.groupBy("phrase", "k", "i").agg(F.sum("df").alias("cost"))
    best = costs.groupBy("phrase", "k").agg(F.count("*").alias("found"), F.min(F.struct("cost", "i")).alias("c")).where("found = k").select("phrase", F.col("c.i").alias("i"))
    wanted = placed.join(best, ["phrase", "i"]).select("phrase", "word")
    return words.join(wanted, "word").select(text_id, F.col("phrase").alias(phrase)).distinct()


def containing(texts: DataFrame, text_id: str, text: str, phrases: DataFrame, phrase: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """text_id, phrase: each pair where the text contains the phrase.

    ``text_id`` must be unique.  Only phrases of several words are compared with the texts
    that have a needed word; null and empty texts and phrases match nothing.
    """
    met = cut(phrase_candidates(texts, text_id, text, phrases, phrase, cut))
    single = ~F.contains(phrase, F.lit(" "))
    held = texts.select(text_id, text).join(met.where(~single), text_id).where(F.contains(text, phrase)).select(text_id, phrase)
    return met.where(single).unionByName(held)
