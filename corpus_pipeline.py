"""A corpus pipeline of five stages over the operators of ``millrace.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is
written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``docs`` for the documents they keep:

1. ``quality`` keeps documents that the nearest-neighbour vote scores at its
   threshold or above;
2. ``language`` keeps documents with a learned language of at least
   ``LEAST_LANGUAGE`` probability (``und`` goes);
3. ``near_duplicates`` keeps one document of each group linked at Jaccard 0.8 or
   more over five-word shingles (documents without words are in no group);
4. ``decontamination`` drops documents that hold ten consecutive words of a
   benchmark item, or all words of a shorter one;
5. ``tokens`` encodes to byte-level BPE ids and decodes them again.

Rows are told apart by their place in the stage's input, so repeated doc_ids are
separate documents and repeated rows are copies.  A stage that needs these places
in more than one job writes the numbered rows first, as a later scan of the same
files may be split otherwise.  What a stage needs only on the way is deleted once
the rows that it drops are written.

Any column may be null, and other columns are carried along whatever their names;
an empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bigru_langid, knn_quality, monoid_bpe, positional_index, prefix_tree_join
from millrace.llm.common import Scratch, read, spare

LEAST_LANGUAGE = 0.3
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 4, 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the vote of labelled neighbours keeps.

    Null and empty texts score 0 and go; repeated rows stay or go together; a score
    equal to the threshold stays.  Without any usable label every score is 0.5 and
    all stay.  Null ids are scored but never learned from.
    """
    model = knn_quality.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    score = spare(docs, "score")
    return knn_quality.score_documents(docs, model, score).where(F.col(score) >= knn_quality.THRESHOLD).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Null texts and texts without a letter are ``und`` and go; repeated rows stay or
    go together; a probability equal to the least stays.  Without any learned
    language all are ``und``.  ``LEAST_LANGUAGE`` is just above chance for four
    languages, so that no clean document is lost to an uncertain net.
    """
    net = bigru_langid.fit(docs, F.lit(True))
    found = spare(docs, "found")
    known = (F.col(f"{found}.lang_pred") != bigru_langid.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_LANGUAGE)
    return bigru_langid.identify(docs, net, found).where(known).select(*docs.columns)


def numbered_rows(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` written once with a row number, and the name of its column."""
    row = spare(docs, "row_no")
    return scratch.table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the first in the input.

    Null texts and texts without words are in no group and stay; of repeated rows
    and of copies with one similarity alike the first row stays.
    """
    scratch, passing = Scratch(spark, "near-duplicates"), Scratch(spark, "near-duplicates-passing")
    numbered, row = numbered_rows(docs, scratch)
    by_row = numbered.select(F.col(row).alias("doc_id"), "text")
    found = prefix_tree_join.jaccard_components(by_row, NEAR_WORDS, NEAR_NUM, NEAR_DEN, passing)
    gone = scratch.table(found.where("doc_id <> component_id").select(F.col("doc_id").alias(row)), "gone")
    passing.drop()
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null texts and texts without words hold none and stay; repeated rows stay or go
    together; an empty benchmark keeps all.
    """
    scratch, passing = Scratch(spark, "decontamination"), Scratch(spark, "decontamination-passing")
    numbered, row = numbered_rows(docs, scratch)
    index = positional_index.written_index(numbered, passing, "segments", F.col(row))
    hits = positional_index.phrase_matches(index, read(spark, sf_dir, "benchmark")).select("row_no").distinct()
    gone = scratch.table(hits.select(F.col("row_no").alias(row)), "gone")
    passing.drop()
    return numbered.join(gone, row, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document; a null text is empty, and every row has its row."""
    return monoid_bpe.query(spark, sf_dir, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can't express the classifiers, so the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
