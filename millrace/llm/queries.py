"""The operators' queries over their whole tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, decontam, extract, langid, linededup, mix, neardup, quality, sql, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(_table(spark, sf_dir, "documents")).drop("passes", "spans")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered(_table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(sql.CONTROL).alias("text"))
    return chat.digests(chat.formatted(rows.unionByName(control)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("n_lines")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"), least=0)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.remove_repeated_windows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix, op2_url_filter, op3_decontaminate, op4_language_id, op5_extract, op6_near_dedup, op7_chat, op8_quality, op9_warc, op10_line_dedup)
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": sql.url_filter(urlfilter.RULES, urlfilter.HIDDEN, urlfilter.HREF, urlfilter.STEPS, urlfilter.DAMPING, urlfilter.THRESHOLD),
    "op3_decontaminate": sql.DECONTAMINATION,
    "op4_language_id": sql.language_id(langid.PROFILE),
    "op6_near_dedup": sql.NEAR_DEDUP,
    "op7_chat": sql.CHAT,
    "op8_quality": sql.quality(quality.RULES, quality.SEQUENCE, quality.RISK, quality.LEVEL),
    "op9_warc": sql.WARC,
    "op10_line_dedup": sql.LINE_DEDUP,
}
