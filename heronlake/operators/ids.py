"""Composite ids and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_passage_id(c: Column) -> Column:
    """parent, start, end and method of a passage id: doc_s-e-a-b, else parent-start-end, else the id itself."""
    four, tail = r"^(.+)_(\d+)-(\d+)-(\d+)-(\d+)$", r"^(.+)-(\d+)-(\d+)$"
    num = lambda p, i: F.regexp_extract(c, p, i).try_cast("long")
    return (
        F.when(c.rlike(four), F.struct(F.regexp_extract(c, r"^(.+_\d+-\d+)-\d+-\d+$", 1).alias("parent"), num(four, 2).alias("start"), num(four, 3).alias("end"), F.lit("underscore_span").alias("method")))
        .when(c.rlike(tail), F.struct(F.regexp_extract(c, tail, 1).alias("parent"), num(tail, 2).alias("start"), num(tail, 3).alias("end"), F.lit("tail_pair").alias("method")))
        .otherwise(F.struct(c.alias("parent"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit("as_is").alias("method")))
    )


def parent_of_chunk(c: Column, mark: str = "__c") -> Column:
    """The id before the last chunk number; an id without one is its own parent."""
    return F.regexp_replace(c, mark + r"\d+$", "")


def conversation_of(task_id: Column) -> Column:
    """The part before <::>, or before :: in raw ids."""
    return F.when(task_id.contains("<::>"), F.element_at(F.split(task_id, "<::>"), 1)).otherwise(F.element_at(F.split(task_id, "::"), 1))


def resolve_ids(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted.id to known.id: exact; else one known id whose part after the first _ is the wanted id; else one known id that
    is the wanted id's part after its first _. Several candidates of the first method that has any give none."""
    suffix = lambda c: F.regexp_extract(c, "^[^_]*_(.+)$", 1)
    w, k = wanted.select("id").distinct(), known.select(F.col("id").alias("cand")).distinct()
    a = w.join(k, F.col("id") == F.col("cand")).withColumn("m", F.lit(1))
    b = w.join(k.withColumn("s", suffix(F.col("cand"))).where("s <> ''"), F.col("id") == F.col("s")).drop("s").withColumn("m", F.lit(2))
    c = w.withColumn("s", suffix(F.col("id"))).where("s <> ''").join(k, F.col("s") == F.col("cand")).drop("s").withColumn("m", F.lit(3))
    g = a.unionByName(b).unionByName(c).groupBy("id", "m").agg(F.count(F.lit(1)).alias("n"), F.min("cand").alias("cand"))
    best = g.groupBy("id").agg(F.min(F.struct("m", "n", "cand")).alias("x"))
    names = F.element_at(F.array(F.lit("exact"), F.lit("suffix"), F.lit("reverse_suffix")), F.col("x.m"))
    d = w.join(best, "id", "left")
    return d.select("id", F.when(F.col("x.n") == 1, F.col("x.cand")).alias("resolved"), F.when(F.col("x").isNull(), "missing").when(F.col("x.n") > 1, "ambiguous").otherwise(names).alias("method"))
