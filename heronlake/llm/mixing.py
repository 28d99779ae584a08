"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) divided by its quality weight, where u comes from a
digest of seed, id and text; within a source the documents are taken in key order until the source's token
budget is spent. Budgets over a source's size take complete epochs first.

The running sums that say where a budget ends are made in two levels, so that no task meets a whole
source: keys are dealt to ranges of their logarithm, ``BUCKETS`` to a factor of two, ranges are summed (at most
sources x 80 x BUCKETS rows), and rows are summed within their range only. The logarithm of an exponential variable has a
density of at most 1/e whatever its scale, so of the documents of one weight, short or long, none of the ranges holds more
than 1 in 900.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last
in order; rows with equal keys (repeated rows) go by id, then size, then text digest; an empty table
gives an empty result; extra columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import BLANKS, WS, fresh, text_or_empty, written

BUCKETS = 256
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = 17


def quality_weight(n: Column, symbols: Column) -> Column:
    """In (0, 1]: less for documents with many symbols a word, and for very short ones."""
    return (n.cast("double") / (n + F.lit(20))) / (F.lit(1.0) + F.lit(10.0) * symbols.cast("double") / F.greatest(n, F.lit(1)))


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of a digest of seed, id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("null")), F.lit("|"), F.md5(text)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def sized(df: DataFrame, id_col: str, source_col: str, text_col: str, seed: int = SEED) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with size, sampling key, key range, source key and text digest; the names of those columns."""
    names = dict(zip(("words", "sym", "size", "key", "bucket", "source", "tie"), fresh(df, "words", "sym", "size", "key", "bucket", "source", "tie")))
    t = text_or_empty(text_col)
    trimmed = F.btrim(t, F.lit(BLANKS))
    d = df.withColumn(names["size"], F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WS + "+"))).cast("long"))
    d = d.withColumn(names["sym"], F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")))
    weight = F.greatest(quality_weight(F.col(names["size"]), F.col(names["sym"])), F.lit(1e-6))
    d = d.withColumn(names["key"], -F.log(uniform(F.col(id_col), t, seed)) / weight)
    d = d.withColumn(names["bucket"], F.floor(F.lit(BUCKETS) * F.log2(F.least(F.greatest(F.col(names["key"]), F.lit(2.0**-40)), F.lit(2.0**40)))).cast("int"))
    d = d.withColumn(names["source"], F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")))
    d = d.withColumn(names["tie"], F.xxhash64(t))
    return d.drop(names["sym"]), {k: v for k, v in names.items() if k not in ("words", "sym")}


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """A row for each source (source, source_size) -> with target: ``share`` of all words by weight, where
    no target passes ``limit`` times its source and the rest is shared again. Sources in code-point order
    get the weights in turn. The windows run over one row for each source."""
    by_name = Window.orderBy("source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    d = totals.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    d = d.withColumn("cap", F.col("source_size").cast("double") * F.lit(float(limit))).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "source")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    d = d.withColumn("level", level)
    # sources are full in order of cap / w; the first that isn't gives the level of all that follow
    d = d.withColumn("open", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything))
    return d.select("source", "source_size", F.when(F.col("open").isNull() | (F.col("ratio") <= F.col("open.level")), F.col("cap")).otherwise(F.col("w") * F.col("open.level")).alias("target"))


def starts(small: DataFrame, names: dict[str, str], **shares) -> DataFrame:
    """For each source and key range: words of the source before it, the source's size and target."""
    ranges = small.groupBy(F.col(names["source"]).alias("source"), F.col(names["bucket"]).alias("bucket")).agg(F.sum(names["size"]).alias("n"))
    ranges = written(ranges, "mix-ranges")
    goal = targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), **shares)
    prefix = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.withColumn("start", prefix).join(goal, "source").select("source", "bucket", "start", "source_size", "target")


def taken(d: DataFrame, names: dict[str, str], id_col: str, at: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``d`` with source_size, target, epochs and the words of the last, partial epoch (``part``, of which
    the boundary document may have some only), and ``before``, the words of its source that go before it."""
    names = names | dict(zip(("start", "source_size", "target", "epochs", "rest", "before", "part"), fresh(d, "start", "source_size", "target", "epochs", "rest", "before", "part")))
    k1, k2 = fresh(d, "k1", "k2")
    at = at.select(F.col("source").alias(k1), F.col("bucket").alias(k2), *[F.col(c).alias(names[c]) for c in ("start", "source_size", "target")])
    d = d.join(at, (F.col(names["source"]) == F.col(k1)) & (F.col(names["bucket"]) == F.col(k2))).drop(k1, k2)
    w = Window.partitionBy(names["source"], names["bucket"]).orderBy(names["key"], F.col(id_col), names["size"], names["tie"]).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn(names["before"], F.col(names["start"]) + F.coalesce(F.sum(names["size"]).over(w), F.lit(0)))
    size = F.col(names["source_size"])
    d = d.withColumn(names["epochs"], F.when(size > 0, F.floor(F.col(names["target"]) / size)).otherwise(0).cast("long"))
    d = d.withColumn(names["rest"], F.round(F.col(names["target"]) - F.col(names["epochs"]) * size).cast("long"))
    d = d.withColumn(names["part"], F.least(F.col(names["size"]), F.greatest(F.lit(0).cast("long"), F.col(names["rest"]) - F.col(names["before"]))))
    return d, names


def mixture(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, **shares) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken. ``taken`` is epochs x size
    plus what the partial epoch has of the document; the document at the boundary gives just the words that
    are missing, so a source's words sum up to its target, rounded."""
    base = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    d, names = sized(base, "doc_id", "source", "text", seed)
    d = written(d.drop("text"), "mix-sizes")  # texts are read once; what follows moves a few numbers a document
    d, names = taken(d, names, "doc_id", starts(d, names, **shares))
    return d.select(
        "doc_id", "source", F.col(names["size"]).alias("size"), F.col(names["source_size"]).alias("source_size"), F.col(names["target"]).alias("target"),
        (F.col(names["epochs"]) * F.col(names["size"]) + F.col(names["part"])).alias("taken"),
    )


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, **shares) -> DataFrame:
    """The documents of the mix with the columns of ``df``, a row for each time a document is taken. Documents
    stay whole: the one at the boundary is in if at least half of it fits."""
    d, names = sized(df, id_col, source_col, text_col, seed)
    small = written(d.select(*[names[k] for k in ("source", "bucket", "size")]), "mix-sizes")
    d, names = taken(d, names, id_col, starts(small, names, **shares))
    copies = F.col(names["epochs"]) + F.when(F.lit(2) * F.col(names["part"]) >= F.greatest(F.col(names["size"]), F.lit(1)), 1).otherwise(0)
    d = d.where(copies > 0).withColumn(names["rest"], F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return d.select(*[d[c] for c in df.columns])
