"""Runs against brute force, ties included, and how much they move."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.operators import irmetrics as ir
from heronlake.operators import retrieval as rt
from heronlake.plans import registry
from tests.conftest import SF


@pytest.fixture(scope="module")
def vectors(spark):
    """Few values, so that most scores are ties, and queries among the documents."""
    x = np.random.default_rng(3).integers(-1, 2, (90, 3)).astype(float)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, d array<double>")
    q = d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("qid"), F.col("d").alias("q"))
    s = {i: sorted((-float(x[i] @ x[j]), j) for j in range(90) if j != i) for i in range(0, 90, 10)}
    return q, d, s


def rows(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("positive", [False, True])
def test_ties_go_by_id(spark, vectors, positive):
    q, d, s = vectors
    best = {i: [(t, j) for t, j in x if t < 0 or not positive] for i, x in s.items()}
    for k in (1, 7, 100):
        got = rows(rt.dense_topk_blocks(q, d, k, positive), "qid", "doc_id", "rank", "score")
        assert got == {(i, j, r + 1, -t) for i, x in best.items() for r, (t, j) in enumerate(x[:k])}
    for whole in (rt.WHOLE, 0):  # both ways
        kept, rt.WHOLE = rt.WHOLE, whole
        try:
            got = rows(rt.ranked_pairs(q, d, positive), "qid", "doc_id", "rank", "score")
        finally:
            rt.WHOLE = kept
        assert got == {(i, j, r + 1, -t) for i, x in best.items() for r, (t, j) in enumerate(x)}


def test_parents_and_pairs(spark, vectors):
    q, d, s = vectors
    best = {}
    for i, x in s.items():
        for t, j in x:
            best[i, j // 4] = max(best.get((i, j // 4), -9.0), -t)
    got = rt.best_of_parents(q, d.withColumn("parent", F.floor(F.col("doc_id") / 4)))
    assert rows(got, "qid", "doc_id", "score") == {(*k, v) for k, v in best.items()}
    pairs = spark.createDataFrame([(0, 1, "a"), (0, 5, "b"), (10, 5, "c")], "qid long, doc_id long, x string")
    score = {i: {j: -t for t, j in x} for i, x in s.items()}
    want = {(i, j, x, v if (v := score[i][j]) > 0 else None) for i, j, x in ((0, 1, "a"), (0, 5, "b"), (10, 5, "c"))}
    assert rows(rt.pair_scores(pairs, q, d), "qid", "doc_id", "x", "rerank_score") == want


def test_metrics_of_classes(spark, vectors):
    q, d, _ = vectors
    run = rt.dense_topk_blocks(q, d, 12)
    ids = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") != 30, F.col("doc_id") % 7).alias("class"))
    a, b = ids.toDF("qid", "a").where("qid % 10 = 0"), ids.toDF("doc_id", "b")
    qrels = a.join(b, F.col("a") == F.col("b")).where("qid <> doc_id").select("qid", "doc_id", F.lit(1).alias("rel"))
    show = lambda m: sorted(tuple(round(v, 12) for v in r) for r in m.collect())
    got = show(ir.per_query_of_classes(run, ids))
    assert got == show(ir.per_query(run, qrels)) and len(got) == 8


NAMES = ["rr_cross", "win_rank_desc", "rr_alpha", "top_rerank", "agg_run_cmp", "agg_passage_max", "rep_qid_diff", "fus_rrf", "fus_rrf_file", "agg_sweep_rank", "fus_sweep", "jn_postings", "fus_hybrid", "set_topk_sets", "jn_fuse_outer", "srt_multi", "top_fused", "agg_overlap", "fus_linear", "agg_compare_reports"]


@pytest.mark.parametrize("name", NAMES)
def test_pairs_stay_in_their_tasks(spark, name):
    """No join on tokens, vectors or labels makes a row of a pair of vectors."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Join Cross" not in plan and "Join Inner, (label#" not in plan
    assert "Join Inner, NOT" not in plan
