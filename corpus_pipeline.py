"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Counted as part of the subpackage millrace.llm. Every stage works on all that the one before it kept.

In every stage a null in any column does no harm, repeated rows are rows of their own (near-dedup keeps one of each group), texts of any length are whole rows of a
task, an empty table gives an empty table, and columns besides those of documents stay, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, linededup, mix, neardup
from millrace.llm.common import SPACE, delete, scratch, write_and_read

#: Documents nearer to no language than this have next to none of its frequent n-grams.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, null and empty ones among them, and those that are like none of the languages learned."""
    found = langid.identify(docs, langid.fit(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated three-line windows out of texts; documents of which no word is left go. Null and short texts stay as they are."""
    left = linededup.remove_repeated_windows(docs)
    word = F.col("text").rlike(f"[^{SPACE[1:]}")
    return left.where((F.col("n_removed") == 0) | word).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, on shingles of five words: that of the smallest doc_id. Null and empty texts are in no group."""
    return neardup.deduplicate(docs, words=5, percent=80).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: documents with the words that the mix takes of them as their text, how many these are, and their source's size and target."""
    mixed = mix.mixed_texts(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("bigint"))


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near), ("benchmark decontamination", leaks), ("source mixing", mixture)]

#: Language ID and near-dedup can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{scratch(spark)}/{name.replace(' ', '-').lower()}-{uuid.uuid4().hex}"
        docs = write_and_read(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)  # what the next stage has read whole isn't needed again
        before = path
    return docs
