"""Connected components of large graphs, by repeated contraction, and small filters of large sets of digests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import written

#: A hot key of a join is dealt to so many tasks.
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join on ``key``, which ``right`` has once: rows of one key go to ``SALTS`` tasks by a digest of ``spread``."""
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.withColumn("salt", F.pmod(F.xxhash64(spread, F.lit(3)), F.lit(SALTS))).join(salted, [key, "salt"]).drop("salt")


def components(edges: DataFrame, name: str = "components", values: DataFrame | None = None, counted: str = "true") -> DataFrame:
    """node, root, size, value for every node of ``edges`` (columns a, b of one type, not null): equal roots, the least node
    of the component, for connected nodes; the number of its nodes that are ``counted`` (SQL over node); the least of its nodes' values (columns node, value;
    null if there are none).

    In each round a node points to the neighbour (or itself) whose digest is least, twice over, and edges are
    contracted along the pointers, until none is left; the number of nodes falls by a steady factor, as the
    digests are random. Only minima are gathered, so a node with very many neighbours is pre-aggregated. Each
    round's pointers are written, and nothing but a count reaches the driver. An empty input gives no rows.
    """
    e = written(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    steps: list[DataFrame] = []
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b"), F.col("b").alias("id"))).alias("m"))
        own = F.struct(F.xxhash64("a"), F.col("a").alias("id"))
        p = written(low.select("a", F.least(own, F.col("m"))["id"].alias("to")), f"{name}-p")
        if not p.take(1):
            break
        hop = p.select(F.col("a").alias("to"), F.col("to").alias("far"))
        p = written(p.join(hop, "to", "left").select("a", F.coalesce("far", "to").alias("to")), f"{name}-pp")
        steps.append(p)
        pa, pb = p.select("a", F.col("to").alias("ta")), p.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        e = written(e.join(pa, "a").join(pb, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct(), f"{name}-e")
    nodes = edges.select(F.col("a").alias("node"))
    if values is None:
        values = nodes.limit(0).select("node", F.lit(None).cast("long").alias("value"))
    if not steps:
        return nodes.limit(0).select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("size")).join(values, "node")
    out = steps[0].select(F.col("a").alias("node"), "to")
    for p in steps[1:]:
        out = out.join(p.select(F.col("a").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    out = written(out.join(values, "node", "left").select("node", "to", "value"), f"{name}-out")
    least = out.groupBy("to").agg(F.min("node").alias("root"), F.count_if(F.expr(counted)).alias("size"), F.min("value").alias("least"))
    return salted_join(out, least, "to", "node").select("node", "root", "size", F.col("least").alias("value"))


class Filter:
    """A Bloom filter of 64-bit digests, of 2^26 bits (8 MB) at most however many they are: it says no only of digests
    that it hasn't got."""

    def __init__(self, digests: DataFrame, column: str):
        import numpy as np

        n = digests.count()
        self.bits = 1 << max(10, min(26, math.ceil(math.log2(16 * n + 1))))
        places = F.array(*[(F.shiftrightunsigned(column, s)).bitwiseAND(F.lit(self.bits - 1)) for s in (0, 22, 38)])
        d = digests.select(F.explode(places).alias("p"))
        d = d.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS int))").alias("bit"))
        rows = d.groupBy(F.col("w").cast("int").alias("w")).agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^20 rows of 12 bytes at most
        self.words = np.zeros(self.bits // 64, dtype=np.int64)
        self.words[rows.column("w").to_numpy()] = rows.column("bits").to_numpy()

    def may_have(self, digests):
        """For an array of signed 64-bit numbers."""
        import numpy as np

        x, out = digests.view(np.uint64), True
        words = self.words.view(np.uint64)
        for s in (0, 22, 38):
            p = (x >> np.uint64(s)) & np.uint64(self.bits - 1)
            out = out & ((words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
        return out
