"""The pipeline's stages against what each of them should keep."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from heronlake.llm import mixing, quality_rules
from tests.conftest import SF
from tests.llm.test_ops import brute_components, brute_join, near_copies


def test_stages(spark):
    from heronlake.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = ({r.doc_id: r for r in d.collect()} for d in kept["quality_rules"])
    verdicts = {r.doc_id: r for r in quality_rules.quality_rules(kept["quality_rules"][0]).collect()}
    assert after.keys() == {i for i, r in verdicts.items() if r.kept}
    # of those labelled good none goes but by the base rules
    assert not [i for i in before.keys() - after.keys() if labels.get(i) == 1 and not verdicts[i].base_failed]
    before, after = ({r.doc_id for r in d.collect()} for d in kept["quality_model"])
    assert after <= before and sum(labels.get(i) == 1 for i in before - after) <= 1 and sum(labels.get(i) == 0 for i in after) <= 1
    before, after = kept["ngram_join"]
    rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
    assert {r.doc_id for r in after.collect()} == {rows[i][0] for i in set(brute_groups(rows).values())}
    before, after = kept["mixing"]
    taken = Counter(r.doc_id for r in after.collect())
    plan = {r.doc_id: r for r in mixing.mixture(before).collect()}
    assert all(abs(taken[i] * r.size - r.taken) <= r.size / 2 + 1 for i, r in plan.items())
    before, after = kept["sentencepiece"]
    assert after.count() == before.count() and after.where("NOT lossless").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "lossless"] and out.count() > 0


def test_rules_stage_keeps_its_filter_in_place(spark):
    """The features are computed once, however often the filter refers to them."""
    d = quality_rules.filter_quality(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and plan.count("regexp_count") <= 3


def brute_groups(rows):
    """Least position of each row's group, by brute force at 5 words and 0.8; rows: (id, text)."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return brute_components(range(len(rows)), links)


def test_near_copies_at_five_words(spark):
    rows = near_copies()
    groups = brute_groups(rows)
    assert set(groups.values()) != set(brute_components([i for i, _ in rows], brute_join(rows)[1]).values())
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))


def test_one_row_of_each_group(spark):
    """Rows of one id, null ids, and components of null ids alone beside null ids in other groups."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, a), (7, a), (8, a + " z"), (None, a), (None, b), (None, b + " z"), (None, c), (3, c), (3, c + " z"), (4, ""), (4, ""), (None, None), (None, None)]
    groups = brute_groups(rows)
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)), SF)
    assert kept.columns == ["doc_id", "text", "row"]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(groups.values())) == 7
    assert sorted(got, key=str) == sorted([(7, a), (3, next(t for i, t in got if i == 3)), (4, ""), (4, ""), (None, None), (None, None), (None, next(t for i, t in got if i is None and t))], key=str)
    assert {t for i, t in got if i == 3} <= {c, c + " z"} and {t for i, t in got if i is None and t} <= {b, b + " z"}
