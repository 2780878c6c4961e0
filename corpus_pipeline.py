"""Corpus preparation in five stages: language ID, exact dedup, near-dedup, mixing to target weights, packing.

Each stage works on all that the one before it kept; all but the last return the columns of ``documents``.  Every
decision is made for a row by its own text, whatever its id: a row is known by the file that it is read from and its
place there.  What a stage drops is a bitmap of such places, so no text is shuffled or copied to drop rows.

All stages take null in any column (a null text counts as empty), empty and very long texts, repeated rows, rows that
share an id, empty tables (an empty result), and further columns, which stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gigmatch.llm import exact_dedup, language, mixing, packing, simhash
from gigmatch.llm.common import documents, materialise

#: Texts with letters whose language is less certain than this are rejected, like those without letters.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a recognised language: null and empty texts and texts without a letter go, as do uncertain ones.

    Without any text of known language nothing can be recognised, and all rows go.
    """
    return language.keep_known(docs, LEAST_SCORE, stored=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for white space: the smallest doc_id, null ids last; of rows that
    also share the id any one."""
    return exact_dedup.keep_first(docs, stored=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, by fingerprint or 5-word Jaccard similarity: the smallest doc_id, null
    ids last.  Texts without words are near copies of each other."""
    return simhash.keep_one(docs, stored=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by the rates that bring the domains' tokens to their targets; rates are at most 1, so none repeats.

    All rows stay if the labels lack one of the domains.  A draw depends on the id alone, so copies of one row under
    one id stay or go together if their texts have equal rates; texts without tokens count for no total.
    """
    return mixing.sample_by_rate(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), stored=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row with their sequence and place; a null or empty text is its end mark alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Learned models and fingerprints aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
