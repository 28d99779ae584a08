"""Hand-computed cases of validators, readers, caches, conversations, chunks and providers."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from heronlake.functions import providers as pv
from heronlake.operators import chunking, conversations, judging, validation
from heronlake.sources import io


def test_prediction_problems(spark):
    lines = [
        '{"task_id": "a", "Collection": "c", "contexts": [{"document_id": "d", "score": true}]}',
        '{"task_id": 1, "contexts": [4, {"document_id": null}]}',
        "[1, 2]", "{", "", '{"task_id": "a", "Collection": "c", "contexts": []}',
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    got = {tuple(r) for r in validation.prediction_problems(df, "line", "n", "retrieval_taska").collect()}
    assert got == {
        (1, "error", "task_id is no string"), (1, "error", "missing Collection"), (1, "error", "contexts[0] is no object"), (1, "error", "contexts[1].document_id is no string"), (1, "error", "contexts[1] missing score"),
        (2, "error", "missing task_id"), (2, "error", "missing Collection"), (2, "error", "missing contexts"), (3, "error", "not JSON"), (5, "warning", "empty contexts"),
    }
    assert validation.prediction_problems(df.limit(0), "line", "n", "rag_taskc").count() == 0


def test_qrels_of_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"query-id": "q1", "corpus-id": "d1", "score": 1},\n {"qid": "q1", "doc_id": "d2", "rel": 0}\n]\n')
    (tmp_path / "b.json").write_text('{\n "q2": {"d3": 2,\n "d4": 0}\n}\n')
    (tmp_path / "c.tsv").write_text("query-id\tcorpus-id\tscore\nq3\td5\t1\n")
    got = {tuple(r) for r in io.read_qrels_any(spark, str(tmp_path), whole=True).collect()}
    assert got == {("q1", "d1", 1), ("q2", "d3", 2), ("q3", "d5", 1)}


def test_broken_write_leaves_the_table_and_no_part(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_atomic(spark.range(3), path)
    with pytest.raises(PySparkException):
        io.write_atomic(spark.range(3).select(F.raise_error(F.lit("torn")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_conversations_to_queries(spark):
    schema = "conv_id long, turn long, role string, text string, editor string, author string, contexts array<struct<document_id: string, feedback: map<string, string>>>"
    yes, no = [("d1", {"a": "yes"}), ("d2", {"a": "yes", "e": "no"})], [("d3", {"a": "yes", "e": "no"})]
    rows = [(1, 0, "user", "x", "e", "a", None), (1, 1, "agent", "y", "e", "a", yes), (1, 2, "user", "z", "e", "a", None), (1, 3, "agent", "u", "e", "a", no), (1, 4, "user", "w", "e", "a", None)]
    q, r = conversations.to_beir(spark.createDataFrame(rows, schema), 2)
    assert {tuple(x) for x in q.collect()} == {("1_0", "|user|: x"), ("1_4", "|agent|: u\n|user|: w")}
    assert [tuple(x) for x in r.collect()] == [("1_0", "d1", 1)]
    q, _ = conversations.to_beir(spark.createDataFrame(rows, schema), 2, users_only=True)
    assert {tuple(x) for x in q.collect()} == {("1_0", "|user|: x"), ("1_4", "|user|: z\n|user|: w")}


def test_semantic_chunks(spark):
    s = spark.createDataFrame([(1, 0, "a b", [1.0, 0.0]), (1, 1, "c", [1.0, 0.1]), (1, 2, "d e f", [0.0, 1.0])], "k long, i long, t string, v array<double>")
    got = sorted(tuple(r) for r in chunking.semantic_chunks(s, "k", "i", "t", "v", size=2, overlap=1).collect())
    assert got == [(1, "1__c0000", "a b"), (1, "1__c0001", "b c"), (1, "1__c0002", "d e"), (1, "1__c0003", "e f")]


def test_client_waits_and_gives_up():
    client = pv.Client(pv.Unsteady())
    assert client(["abc", "abcd", "abcde"]) == ["no", "yes", None]


def test_rating_or_code(spark):
    rows = [('{"score": 3}', 1.0), ("Rating: [[4]]", 0.4), ("Rating: [[40]]", 0.5), ("none", 0.5), (" ", 0.0), (None, 0.0)]
    got = spark.createDataFrame(rows, "a string, x double").select(judging.rating_or_code(F.col("a")).alias("r"), "x").select("r.*", "x").collect()
    assert [r.score for r in got] == [r.x for r in got]
    assert [r.code for r in got] == ["OK", "OK", "OK", "PARSE_ERROR", "EMPTY_ANSWER", "EMPTY_ANSWER"]
