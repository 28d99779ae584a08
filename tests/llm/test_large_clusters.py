"""Clusters of more sets than a block, whose sets aren't linked, against brute force."""

from __future__ import annotations

import random

from heronlake.llm import ngram_join as nj


def _least(texts, n, percent):
    sets = [set(nj.shingle_set(t, n).tolist()) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_common_passages_and_families(spark, monkeypatch):
    rng = random.Random(5)
    words = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    texts, passage, base = [], words(60), words(70)
    for _ in range(50):  # a passage in common, and some true pairs
        own = [*passage, *words(14)]
        texts.append(own)
        if rng.random() < 0.3:
            texts.append([*own[:-1], *words(1)])
    for _ in range(50):  # copies that are near or less near to each other
        texts.append([w if rng.random() > 0.03 else words(1)[0] for w in base])
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    names, written = [], nj.written
    monkeypatch.setattr(nj, "written", lambda df, name: names.append(name) or written(df, name))
    monkeypatch.setattr(nj, "BLOCK", 8)
    monkeypatch.setattr(nj, "HUBS", 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nj.ngram_join(df, n=5, percent=80).collect()}
    assert [got[i] for i in range(len(texts))] == _least(texts, 5, 80)
    assert "join-rarely" in names
    # sets of the passage meet none but their own pairs
    rare = nj.rare_shingles(nj._sets(df.selectExpr("0L AS c", "doc_id AS d", "true AS probe", "text"), 5), 80)
    assert rare.groupBy("d").count().count() == len(texts)


def test_sets_of_a_crowd_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 4)
    sets = [[*range(9), 100 + i // 2] for i in range(22)]
    rows = [(0, 7, i, i % 3 > 0, s, len(sets), sum(i % 3 > 0 for i in range(22))) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "c long, s long, d long, probe boolean, x array<long>, n_all long, n_probes long")
    for percent, groups in ((81, 1), (90, 11)):
        root = list(range(22))
        for r in nj._join_sets(df, percent, 3).collect():
            root = [min(root[r.a], root[r.b]) if x in (root[r.a], root[r.b]) else x for x in root]
        assert len(set(root)) == groups
