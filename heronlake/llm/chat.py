"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users; a mask lists the character spans to train on, which are the
assistant's turns with their end marks. System turns stay system turns and have no perspective.

A dialogue is rendered in chunks of at most ``CHUNK`` turns (of turn numbers i x CHUNK onwards, and again
at most CHUNK rows of them), so a conversation with very many turns is many bounded rows, and neither
a task nor a string holds it whole. Chunks in the order (block, part) give the dialogue.

Defined cases: null text is empty; a null or blank role is the participant ``unknown``; a null turn comes
first, in block -1; turns with equal numbers go by role, then text; repeated rows are repeated turns; null
conversation ids form one conversation; a conversation with system turns alone has no perspective and
no rows; marks inside texts and names are broken by a backslash; other columns don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import BLANKS

CHUNK = 256
SYSTEM = "system"
UNKNOWN = "unknown"
END = "<|end|>\n"


def _safe(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("\\|>"))


def perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, block, part, n_turns, n_chars, n_target_chars, text, mask: array<struct<start, end>>.

    Offsets count code points of ``text``, end exclusive.
    """
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("n")).alias("key"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.nullif(F.btrim(F.col(role_col), F.lit(BLANKS)), F.lit("")), F.lit(UNKNOWN)).alias("name"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-1)).cast("long"))
    # who speaks is gathered by conversation in a few small rows, then dealt to the blocks; turns move once,
    # by conversation and block
    speakers = turns.where(F.col("name") != SYSTEM).select("key", F.col("name").alias("perspective")).distinct()
    blocks = turns.select("key", "block").distinct()
    views = speakers.join(blocks, "key")
    order = Window.partitionBy("key", "block").orderBy("turn", "name", "text")
    placed = turns.withColumn("part", F.floor((F.row_number().over(order) - 1) / CHUNK).cast("int"))
    d = placed.join(views, ["key", "block"])
    target = F.col("name") == F.col("perspective")
    head = F.when(target, F.lit("<|assistant|>\n")).when(F.col("name") == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), _safe(F.col("name")), F.lit("|>\n")))
    d = d.select(
        "conv_id", "key", "block", "part", "perspective",
        F.struct("turn", "name", F.col("text").alias("raw"), head.alias("head"), F.concat(_safe(F.col("text")), F.lit(END)).alias("body"), target.alias("target")).alias("s"),
    )
    d = d.groupBy("conv_id", "key", "block", "part", "perspective").agg(F.sort_array(F.collect_list("s")).alias("s"))
    spans = F.expr(
        "aggregate(s, named_struct('at', 0, 'spans', CAST(array() AS array<struct<start:int,end:int>>)), (a, x) -> named_struct("
        "'at', a.at + length(x.head) + length(x.body), 'spans', CASE WHEN x.target THEN array_append(a.spans, named_struct("
        "'start', a.at + length(x.head), 'end', a.at + length(x.head) + length(x.body))) ELSE a.spans END), a -> a.spans)"
    )
    d = d.withColumn("mask", spans).withColumn("text", F.expr("array_join(transform(s, x -> concat(x.head, x.body)), '')"))
    return d.select(
        "conv_id", "perspective", "block", "part", F.size("s").cast("long").alias("n_turns"), F.length("text").cast("long").alias("n_chars"),
        F.expr("CAST(aggregate(mask, 0L, (a, m) -> a + m.end - m.start) AS long)").alias("n_target_chars"), "text", "mask",
    )
