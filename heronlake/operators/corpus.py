"""Corpus quality: duplicates, bad passages, blacklists, integrity, and statistics of lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions.text import norm_dedup


def words(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")


def duplicate_groups(df: DataFrame, id_col: str, text_col: str, protected: DataFrame | None = None) -> DataFrame:
    """member, rep, count, drop: documents whose normalised texts are equal, with the least id as representative; all others
    but protected ones are to drop. Groups are counted by digest, texts don't move."""
    d = df.select(F.col(id_col).alias("member"), F.sha1(norm_dedup(F.col(text_col))).alias("h"))
    g = d.groupBy("h").agg(F.min("member").alias("rep"), F.count(F.lit(1)).alias("count")).where("count >= 2")
    m = d.join(g, "h")
    keep = F.lit(False)
    if protected is not None:
        p = protected.select(F.col(protected.columns[0]).alias("member"), F.lit(True).alias("safe")).distinct()
        m, keep = m.join(p, "member", "left"), F.coalesce(F.col("safe"), F.lit(False))
    return m.select("member", "rep", "count", ((F.col("member") != F.col("rep")) & ~keep).alias("drop"))


def group_report(groups: DataFrame, df: DataFrame, id_col: str, text_col: str, shown: int = 200, snippet: int = 300) -> DataFrame:
    """rep, count, dropped, protected, members, snippet of ``duplicate_groups``. Only the first ``shown`` members are gathered;
    the numbers are of all."""
    n = groups.groupBy("rep").agg(F.max("count").alias("count"), F.count_if("drop").alias("dropped"), F.count_if(~F.col("drop") & (F.col("member") != F.col("rep"))).alias("protected"))
    some = groups.select("rep", "member").withColumn("__r", F.row_number().over(Window.partitionBy("rep").orderBy("member"))).where(F.col("__r") <= shown)
    some = some.groupBy("rep").agg(F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",").alias("members"))
    return n.join(some, "rep").join(df.select(F.col(id_col).alias("rep"), F.substring(text_col, 1, snippet).alias("snippet")), "rep", "left")


def bad_passages(df: DataFrame, text_col: str, n_tokens: Column, low: int = 2, high: int = 850) -> DataFrame:
    """Rows with reasons: empty, too_short, too_long; and the first 300 characters."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    blank = F.trim(F.regexp_replace(t, r"\s+", " ")) == ""
    reasons = F.array_compact(F.array(F.when(blank, "empty"), F.when(n_tokens < low, "too_short"), F.when(n_tokens > high, "too_long")))
    return df.withColumn("reasons", reasons).withColumn("snippet", F.substring(t, 1, 300)).where(F.size("reasons") > 0)


def split_by(df: DataFrame, blacklist: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed)."""
    return df.join(blacklist, key, "left_anti"), df.join(blacklist, key, "left_semi")


#: Bounds of the token-length histogram; the last bin is closed.
BINS = (0, 16, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448, 480, 512, 1024)


def length_stats(df: DataFrame, n: Column, keys: list[str]) -> DataFrame:
    d = df.withColumn("n", n)
    share = lambda cond: F.round(F.avg(cond.cast("double")) * 100, 6)
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.min("n").cast("long").alias("min"), F.max("n").cast("long").alias("max"), F.round(F.avg("n"), 6).alias("mean"),
        *[F.round(F.percentile("n", p / 100), 6).alias(f"p{p}") for p in (10, 50, 90, 99)], share(F.col("n") < 128).alias("under_128"), share(F.col("n") >= 480).alias("from_480"),
    )


def histogram(df: DataFrame, n: Column, bins=BINS) -> DataFrame:
    label = None
    for low, high in zip(bins, bins[1:]):
        last = high == bins[-1]
        cond = (n >= low) & ((n <= high) if last else (n < high))
        label = (F if label is None else label).when(cond, f"[{low},{high}{']' if last else ')'}")
    d = df.select(label.otherwise("over").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    return d.withColumn("pct", F.round(F.col("count") * 100 / F.sum("count").over(Window.partitionBy()), 6))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.asc(order)))).where("__r = 1").drop("__r")
