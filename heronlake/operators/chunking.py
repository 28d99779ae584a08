"""Chunks, packs and spans of documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """array<struct<start, end>> of token windows; the last is the first that reaches the end."""
    step = size - overlap
    n = F.size(tokens)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: (s == 0) | (s - step + size < n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))


def union_intervals(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals of a key as one."""
    w = Window.partitionBy(key).orderBy(start, end)
    d = df.withColumn("__m", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("__g", F.sum(F.when(F.col("__m").isNull() | (F.col(start) > F.col("__m")), 1).otherwise(0)).over(w))
    return d.groupBy(key, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")


def overlaps(chunks: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """Chunks [c_start, c_end) with all passages [p_start, p_end) of the same key that they overlap, and by how much."""
    j = chunks.join(passages, key).where((F.col("p_start") < F.col("c_end")) & (F.col("c_start") < F.col("p_end")))
    return j.withColumn("overlap", F.least("c_end", "p_end") - F.greatest("c_start", "p_start"))


def boundaries(units: DataFrame, key: str, order: str, vector: str, threshold: float) -> DataFrame:
    """segment numbers: a new one starts where the cosine to the unit before falls under the threshold."""
    from heronlake.operators.retrieval import dot

    w = Window.partitionBy(key).orderBy(order)
    d = units.withColumn("__p", F.lag(vector).over(w))
    cosine = dot(F.col("__p"), F.col(vector)) / F.sqrt(dot(F.col("__p"), F.col("__p")) * dot(F.col(vector), F.col(vector)))
    d = d.withColumn("cosine", cosine)
    d = d.withColumn("segment", F.sum(F.when(F.col("cosine") < threshold, 1).otherwise(0)).over(w))
    return d.drop("__p")


def packs(place: list[int], sizes: list[int], most: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(pack, first, last, tokens): adjacent pieces in packs of at most ``most`` tokens (a longer piece alone); the next
    pack starts again with the last pieces of at most ``overlap`` tokens."""
    out, i = [], 0
    while i < len(sizes):
        total, j = sizes[i], i + 1
        while j < len(sizes) and total + sizes[j] <= most:
            total += sizes[j]
            j += 1
        out.append((len(out), place[i], place[j - 1], total))
        if j == len(sizes):
            break
        back, k = 0, j
        while k - 1 > i and back + sizes[k - 1] <= overlap and back + sizes[k - 1] + sizes[j] <= most:
            back += sizes[k - 1]
            k -= 1
        i = k
    return out


def packed_rows(df: DataFrame, key: str, pieces: str, most: int, overlap: int = 0) -> DataFrame:
    """key, pack, first, last, tokens of rows whose ``pieces`` (array<struct<at, n>>) stand in order: ``packs`` row by row,
    without a shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows, out = [], []
            for i, items in enumerate(batch.column(1).to_pylist()):
                found = packs([x["at"] for x in items or ()], [x["n"] for x in items or ()], most, overlap)
                out += found
                rows += [i] * len(found)
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], names=["k", "pack", "first", "last", "tokens"])

    return df.select(key, pieces).mapInArrow(run, f"k {kind}, pack long, first long, last long, tokens long").withColumnRenamed("k", key)


def greedy_pack(df: DataFrame, key: str, order: str, size: str, most: int, overlap: int = 0) -> DataFrame:
    """``packed_rows`` of pieces that are rows of their own: a key's numbers are gathered in one row."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(order, size))), lambda x: F.struct(x[order].cast("long").alias("at"), x[size].cast("long").alias("n")))
    return packed_rows(df.groupBy(key).agg(pieces.alias("pieces")), key, "pieces", most, overlap)


def budget_packs(spans: DataFrame, key: str, budget: int = 512, overlap: int = 100, gap: int = 64, fill: int = 384) -> DataFrame:
    """key, pack, start, end: spans are merged while they fit the budget and the gap to the next is at most ``gap`` (any gap
    until ``fill`` is reached), padded to both sides within the key's extent (``total``), and cut to windows."""
    kind = spans.schema[key].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        rows = pdf.sort_values(["start", "end"])
        total, out, cur = int(rows["total"].max()), [], None
        packs = []
        for s, e in zip(rows["start"].tolist(), rows["end"].tolist()):
            if cur and e - cur[0] <= budget and (s - cur[1] <= gap or cur[1] - cur[0] < fill):
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                packs.append(cur)
        for s, e in packs:
            room = max(0, budget - (e - s))
            left = min(s, room // 2)
            right = min(total - e, room - left)
            left = min(s, room - right)
            s, e = s - left, e + right
            while True:
                out.append((pdf[key].iloc[0], len(out), s, min(s + budget, e)))
                if s + budget >= e:
                    break
                s += budget - overlap
        return pd.DataFrame(out, columns=["k", "pack", "start", "end"])

    return spans.groupBy(key).applyInPandas(run, f"k {kind}, pack long, start long, end long").withColumnRenamed("k", key)


def semantic_chunks(sentences: DataFrame, key: str, order: str, text: str, vector: str, threshold: float = 0.55, size: int = 384, overlap: int = 64) -> DataFrame:
    """key, chunk_id, text: sentences are joined until the cosine to the one before falls under ``threshold``; longer segments
    are cut to windows of ``size`` words. Chunks are numbered through each key."""
    s = boundaries(sentences, key, order, vector, threshold)
    g = s.groupBy(key, "segment").agg(F.array_join(F.sort_array(F.collect_list(F.struct(order, text)))[text], " ").alias("t"))
    g = g.select(key, "segment", F.filter(F.split("t", r"\s+"), lambda w: w != "").alias("t"))
    c = g.select(key, "segment", "t", F.explode(windows(F.col("t"), size, overlap)).alias("w"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("segment", "w.start")) - 1
    return c.select(key, F.format_string("%s__c%04d", F.col(key).cast("string"), n).alias("chunk_id"), F.expr("array_join(slice(t, w.start + 1, w.end - w.start), ' ')").alias("text"))


def cut_spans(text: Column, spans: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` words of each span [start, end) of a text, as spans of the text itself, in order. Offsets are in code
    points; a span without words has none."""
    import re

    word, step = re.compile(r"\S+"), size - overlap

    def one(t, found):
        out = []
        for s in found if t is not None and found is not None else ():
            w = [m.span() for m in word.finditer(t, s["start"], s["end"])]
            out += [{"start": w[i][0], "end": w[min(i + size, len(w)) - 1][1]} for i in range(0, len(w), step) if i == 0 or i - step + size < len(w)]
        return out

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(t: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(t, found)], index=t.index, dtype=object)

    return run(text, spans)


def titled(text: Column, title: Column) -> Column:
    """The text, or the title where the text is blank; null if both are."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"\S"), text).when(F.coalesce(title, F.lit("")).rlike(r"\S"), title)


def document_chunks(docs: DataFrame, units: DataFrame, key: str, order: str, vector: str, threshold: float = 0.55, size: int = 512, overlap: int = 100) -> DataFrame:
    """key, chunk_id, start, stop, text: windows of ``size`` words of a text's segments, with exact offsets. ``docs`` has key and
    text, ``units`` key, order, start, end and a vector; a segment ends where the cosine to the next unit falls under ``threshold``.
    A text of one unit, or of none with a vector, is one segment."""
    s = boundaries(units, key, order, vector, threshold).groupBy(key, "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    s = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("segment", "start", "end"))).alias("s"))
    j = docs.select(key, "text").where(F.col("text").isNotNull()).join(s, key, "left")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    j = j.withColumn("s", F.coalesce(F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), whole))
    c = j.select(key, "text", F.posexplode(cut_spans(F.col("text"), F.col("s"), size, overlap)).alias("i", "w"))
    piece = F.expr("substring(text, w.start + 1, w.end - w.start)")
    return c.select(key, F.format_string("%s__c%06d", F.col(key).cast("string"), "i").alias("chunk_id"), F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("stop"), piece.alias("text"))
