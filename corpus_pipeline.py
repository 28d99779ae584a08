"""Document pipeline: quality rules, quality classifier, near-duplicate join, mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of their input.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm import mixing, ngram_join, quality_model, quality_rules, sentencepiece_dropout
from heronlake.llm.common import fresh, written

#: Near copies share this percentage of their distinct shingles of so many words; op9's own contract is another one.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.filter_quality(docs)


def by_quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents, keeps."""
    return quality_model.filter_classified(docs)


def with_row_keys(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that tell its rows apart whenever they are read; their names. Ids may be null or repeated, so
    a row of a Parquet table is told by file and place, and any other table is written first."""
    names = fresh(docs, "file", "place")
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), names
    except AnalysisException:
        return written(docs.select("*", F.lit(0).cast("long").alias(names[0]), F.monotonically_increasing_id().alias(names[1])), "join-rows"), names


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least id of each group of near copies; of rows with that id one, and null ids come last."""
    keyed, names = with_row_keys(docs)
    (key,) = fresh(keyed, "key")
    keyed = keyed.withColumn(key, F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), *[F.col(n).alias(n) for n in names]))
    joined = ngram_join.ngram_join(keyed, id_col=key, n=NEAR_WORDS, percent=NEAR_PERCENT)
    first = joined.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*[F.col("doc_id")[n].alias(n) for n in names])
    return keyed.join(first, names, "left_semi").select(*[keyed[c] for c in docs.columns])


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken."""
    return mixing.mixed_rows(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and lossless of each row of the mix."""
    return sentencepiece_dropout.encode(docs)


STAGES = [
    ("quality_rules", by_quality_rules),
    ("quality_model", by_quality_model),
    ("ngram_join", one_of_each_group),
    ("mixing", to_target_weights),
    ("sentencepiece", to_tokens),
]

#: The classifier is trained and tokens are drawn by keyed digests, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
