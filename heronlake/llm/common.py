"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it, as a Java character class.
WS = r"[\x20\x09-\x0D]"
#: The characters of that class.
BLANKS = " \t\n\x0b\x0c\r"
#: A word is a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``'s, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__hl_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is absent, the session's checkpoint folder; on a local master alone, where driver and executors are one
    process, a temporary folder of this machine is made. Other masters have to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        existing = sc._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            return existing.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="heronlake-")
        sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there, so a lost
    executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/heronlake-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
