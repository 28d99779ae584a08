"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import queries_sql as sql
from heronlake.llm import chat, html_text, licenses, mixing, ngram_join, pivot_dedup, quality_model, quality_rules, sentencepiece_dropout, warc
from heronlake.llm.common import documents


def op1_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_dropout.encode(documents(spark, sf_dir))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chat.perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return d.withColumn("mask", F.expr("array_join(transform(mask, m -> concat(m.start, '-', m.end)), ',')"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = licenses.license_scan(documents(spark, sf_dir))
    return d.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ","), "score": F.round("score", 6)})


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).withColumn("failed_rules", F.array_join("failed_rules", ","))


def op7_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_dedup.near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir)).withColumn("target", F.round("target", 6))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits an archive of all pages against a replica in which one record in a hundred, by a digest of its id, has a
    changed byte."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    n_files = max(1, -(-pages.count() // warc.PER_FILE))
    a = warc.archived(pages, n_files)
    rot = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("rot|"), F.coalesce(F.col("key").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("long"), F.lit(100)) == 0
    b = a.withColumn("record", F.when(rot, F.overlay("record", F.lit("\u0001"), 6)).otherwise(F.col("record")))
    return warc.fixity(a, b).withColumnRenamed("key", "page_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_dropout": op1_sentencepiece_dropout,
    "op2_quality_model": op2_quality_model,
    "op3_html_text": op3_html_text,
    "op4_chat_perspectives": op4_chat_perspectives,
    "op5_license_scan": op5_license_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_pivot_dedup": op7_pivot_dedup,
    "op8_mixing": op8_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_warc_fixity": op10_warc_fixity,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_perspectives": sql.OP4,
    "op5_license_scan": sql.op5_sql(),
    "op6_quality_rules": sql.OP6,
    "op7_pivot_dedup": sql.OP7,
    "op8_mixing": sql.OP8,
    "op9_ngram_join": sql.OP9,
    "op10_warc_fixity": sql.OP10,
}
