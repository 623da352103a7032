"""The training-text pipeline: five stages over ``documents``, each a corpus operator.

Each stage takes (spark, docs, sf_dir) and returns the next one's documents; ``run`` writes what a
stage returns to the shared folder and reads it back, so a lost executor never costs a stage that
has ended.

In every stage an empty table gives an empty result, any column may hold nulls, other columns are kept whatever their
names (the last stage returns its own), and texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontaminate, neardup, packing, quality, repeats
from tidemill.llm.common import table, written

#: Words and similarity of a near duplicate; bytes of a repeated passage (some 40 words); words of a benchmark window.
SHINGLE, PERCENT, PASSAGE, WINDOW = 5, 80, 240, 10


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are scored as texts without words, repeated rows alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, rows without an id after all others.

    Rows that repeat an id are one document, of which one row stays; null and empty texts are no one's duplicates.
    """
    return neardup.keep_one(docs, SHINGLE, PERCENT)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of ``PASSAGE`` bytes and more cut out; a document of which nothing is left goes.

    The first copy is that of the smallest id, rows without an id after all others; rows that nothing is cut from, null and
    empty texts among them, stay as they are; rows that repeat an id with its text are cut alike.
    """
    return repeats.cut_later_copies(docs, PASSAGE)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window; null and empty texts stay, repeated rows stay or go together."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; null and empty texts are their end id, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The first stage's network has no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
