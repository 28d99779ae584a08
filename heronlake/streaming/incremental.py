"""Incremental work: resuming what is done, and streams over files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(inputs: DataFrame, done: DataFrame, key: str, retry_errors: bool = False, error: str = "error") -> DataFrame:
    """Inputs that have no finished row; with ``retry_errors``, those that ended in an error count as unfinished. Of rows
    with one key the last, by ``at``, counts."""
    last = done.groupBy(key).agg(F.max_by(F.struct("*"), "at").alias("r")).select("r.*")
    finished = last.where(F.col(error).isNull()) if retry_errors else last
    return inputs.join(finished.select(key), key, "left_anti")


def process_files(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], files_at_once: int = 8) -> None:
    """Works on files that weren't seen yet and appends the results, each batch once: the batch number is a partition,
    so a batch that is repeated after a failure replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(events: DataFrame, ts: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and keys over a stream or a table (an extension); rows later than ``late`` behind are left out of a
    stream."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.window(ts, every).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
