"""Hand-computed values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from heronlake.functions import text as tx
from heronlake.operators import chunking as ck
from heronlake.operators import corpus as cp
from heronlake.operators import ids
from heronlake.operators import irmetrics as ir
from heronlake.operators import judging as jd
from heronlake.operators import retrieval as rt
from heronlake.sources import io
from heronlake.streaming import incremental as inc


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rrf(spark):
    run = lambda *rows: rt.ranked(spark.createDataFrame(list(rows), "qid long, doc_id string, score double"))
    a, b = run((1, "A", 0.9), (1, "B", 0.8)), run((1, "B", 5.0), (1, "C", 4.0))
    got = {r.doc_id: round(r.score, 6) for r in rt.fuse_rrf(a, b).collect()}
    assert got == {"B": 0.032522, "A": 0.016393, "C": 0.016129}
    assert {r.doc_id: r.score for r in rt.fuse_linear(a, b).collect()} == {"A": 1.0, "B": 1.0, "C": 0.0}
    assert {round(r.score, 9) for r in rt.fuse_rrf(a, b).collect()} == {round(r.score, 9) for r in rt.fuse_rrf(b, a).collect()}


def test_minmax_of_equal_scores(spark):
    run = spark.createDataFrame([(1, k, 3.0) for k in "abc"], "qid long, doc_id string, score double")
    assert {r.score for r in rt.minmax(run).collect()} == {0.0}


def test_ir_metrics(spark):
    run = spark.createDataFrame([("q", "n", 3.0), ("q", "a", 2.0), ("q", "b", 1.0)], "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", d, 1) for d in "abc"], "qid string, doc_id string, rel int")
    r = ir.per_query(run, qrels).first()
    assert round(r.ndcg_3, 6) == 0.530721 and round(r.recall_3, 6) == 0.666667


def test_weighted(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("b", 3, 0.2)], "collection string, n long, recall double")
    assert round(ir.weighted_all(d, "n", ["recall"]).where("collection = 'all'").first().recall, 6) == 0.275


def test_token_recall_and_rouge(spark):
    d = spark.createDataFrame([(1, "The cat sat on a mat", "cat mat mat"), (2, "", "x"), (3, "a b c d e", "a c e f")], "k long, p string, t string")
    assert [round(r.recall, 6) for r in jd.token_overlap(d, "k", F.col("p"), F.col("t")).orderBy("k").collect()][:2] == [0.666667, 0.0]
    assert [round(r.rouge_l, 6) for r in jd.rouge_l(d, "k", F.col("p"), F.col("t")).orderBy("k").collect()][1:] == [0.0, round(2 * 0.6 * 0.75 / 1.35, 6)]


@pytest.mark.parametrize(("text", "expected"), [("Rating: [[7]]", 0.7), ("Score: 8.6/10", 0.86), ("none", 0.5), ("Rating: [[0]]", 0.5), ("Rating: [[10]]", 1.0)])
def test_rating(spark, text, expected):
    assert value(spark, jd.rating(F.lit(text))) == pytest.approx(expected)


def test_faith_and_rb_agg(spark):
    labels = F.array(*map(F.lit, ("supported", "not_supported", "unverifiable", "supported")))
    assert value(spark, jd.faithfulness(labels)) == 0.625
    assert value(spark, jd.faithfulness(F.array().cast("array<string>"))) == 0.0
    assert round(value(spark, jd.rb_agg(F.lit(0.6), F.lit(0.5), F.array(F.lit(0.1), F.lit(0.2)))), 6) == 0.610169


@pytest.mark.parametrize(("cell", "group"), [('["UNANSWERABLE"]', "unanswerable"), ("['PARTIAL']", "answerable_partial"), ("CONVERSATIONAL", "conversational"), ("", "unknown")])
def test_eval_group(spark, cell, group):
    assert value(spark, jd.eval_group(F.lit(cell))) == group


@pytest.mark.parametrize(
    ("group", "label", "expected"), [("answerable_partial", "no", 0.4), ("answerable_partial", "yes", 0.0), ("unanswerable", "yes", 1.0), ("unanswerable", "partial", 0.0), ("conversational", "yes", None)]
)
def test_idk_condition(spark, group, label, expected):
    assert value(spark, jd.idk_condition(F.lit(group), F.lit(label), F.lit(0.4))) == expected


@pytest.mark.parametrize(("xs", "expected"), [((0.5, 0.5, 1.0), 0.6), ((0.0, 0.5, 1.0), 0.0), ((None, 0.5, 1.0), None)])
def test_harmonic(spark, xs, expected):
    got = value(spark, tx.harmonic(*[F.lit(x).cast("double") for x in xs]))
    assert got is None if expected is None else got == pytest.approx(expected)


@pytest.mark.parametrize(("text", "lang", "score"), [("hello", "en_like", 1.0), ("Привет", "ru_like", 1.0), ("你好", "zh_like", 1.0), ("", "unk", 0.0)])
def test_language(spark, text, lang, score):
    r = value(spark, tx.language(F.lit(text)))
    assert (r.lang, r.score) == (lang, score)


def test_intervals(spark):
    d = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 9, 12)], "k string, start int, end int")
    once = ck.union_intervals(d, "k")
    assert sorted((r.start, r.end) for r in once.collect()) == [(0, 7), (9, 12)]
    assert sorted((r.start, r.end) for r in ck.union_intervals(once, "k").collect()) == [(0, 7), (9, 12)]


def test_windows(spark):
    assert [(w.start, w.end) for w in value(spark, ck.windows(F.sequence(F.lit(1), F.lit(10)), 4, 1))] == [(0, 4), (3, 7), (6, 10)]


def test_passage_ids(spark):
    a, b = (value(spark, ids.parse_passage_id(F.lit(x))) for x in ("822086267_7384-8758-0-1374", "471123-0-798"))
    assert (a.parent, a.start) == ("822086267_7384-8758", 7384) and (b.parent, b.start) == ("471123", 0)
    assert value(spark, ids.conversation_of(F.lit("x<::>1"))) == "x"


def test_packs(spark):
    d = spark.createDataFrame([("k", i, 40) for i in range(7)], "k string, at long, n long")
    packs = ck.greedy_pack(d, "k", "at", "n", 100, 40).orderBy("pack").collect()
    assert [(p.first, p.last) for p in packs] == [(i, i + 1) for i in range(6)] and all(p.tokens <= 100 for p in packs)


def test_duplicates_and_protection(spark):
    d = spark.createDataFrame([(1, "same"), (2, "same"), (3, "same"), (4, "other")], "id long, text string")
    got = cp.duplicate_groups(d, "id", "text", spark.createDataFrame([(3,)], "id long"))
    assert {(r.member, r.rep, r.drop) for r in got.collect()} == {(1, 1, False), (2, 1, True), (3, 1, False)}


def test_nfkc_and_cleaning(spark):
    assert value(spark, tx.nfkc(F.lit("ﬁ"))) == "fi"
    once = value(spark, tx.clean_mixed(F.lit("a  b\n\n\n\nПривет мир\n" + "A" * 130 + " c")))
    assert "Привет" not in once and "AAAA" not in once and value(spark, tx.clean_mixed(F.lit(once))) == once


def test_zip_and_resume(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("q.jsonl", '{"id": "1"}\n\n{"id": "2"}\n')
    assert sorted(r.id for r in io.read_zip(spark, str(tmp_path / "a.zip"), "q.jsonl", "id string").collect()) == ["1", "2"]
    done = spark.createDataFrame([(1, None, 1), (2, "e", 1), (3, "e", 1), (3, None, 2)], "id long, error string, at long")
    left = lambda retry: sorted(r.id for r in inc.pending(spark.range(5), done, "id", retry).collect())
    assert left(False) == [0, 4] and left(True) == [0, 2, 4]


def test_results_do_not_depend_on_partitions(spark):
    from heronlake.plans import registry
    from tests.conftest import SF

    first = sorted(map(tuple, registry.queries()["fus_rrf"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert sorted(map(tuple, registry.queries()["fus_rrf"](spark, SF).collect())) == first
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_dispatch(spark):
    tasks = spark.createDataFrame([(1, "a cat sat", ["a cat", "dog"], ["cat sat here"]), (2, None, [], None)], "k long, prediction string, targets array<string>, passages array<string>")
    short = {"Recall": {"func": "recall", "target": "target"}, "Length": {"func": "length", "target": "target"}}
    assert {(r.k, r.metric): r["values"] for r in jd.dispatch(tasks, "k", short).collect()} == {(1, "Recall"): [1.0, 0.0], (1, "Length"): [9.0, 9.0], (2, "Recall"): [], (2, "Length"): []}
    from heronlake.plans.q_judging import CONFIG

    got = {(r.k, r.metric): r["values"] for r in jd.dispatch(tasks, "k", jd.metric_config(CONFIG)).collect()}
    assert len(got) == 16 and got[2, "RB_agg"] == []
    # Rouge-L of 3 and 2 tokens, 2 in common; BERT recall 1; two of three tokens of the passage, the third by its nearest vector
    k = (got[1, "BertKPrec"][0] + 1) / 2
    assert got[1, "RougeL_stemFalse"] == pytest.approx([0.8, 0.0]) and got[1, "BertscoreR"][0] == pytest.approx(1)
    assert got[1, "Extractiveness_RougeL"] == pytest.approx([2 / 3]) and got[1, "RB_agg"] == pytest.approx([3 / (1 + 1 / 0.8 + 1 / k)])
    with pytest.raises(ValueError):
        jd.dispatch(tasks, "k", {"x": {"func": "none", "target": "target"}})
    with pytest.raises(ValueError):
        jd.metric_config("  func: recall")


def test_rewriting_in_two_passes(spark):
    from heronlake.operators import conversations as cv

    tasks = spark.createDataFrame(
        [("one", ["What is it?"], ["x"]), ("stale", ["Tell me of tides", "why is that so"], ["tides"]), ("no anchor", ["Tell me of tides", "why is that so"], []), ("lost", ["Tell me of moons", "and why then"], ["moons"]), ("empty", None, None)],
        "k string, turns array<string>, anchors array<string>",
    )

    def model(prompts):
        out = []
        for p in prompts:
            last = p.split("] ")[-1].split("\n")[0]
            out.append("" if "moons" in p and "Keywords" not in p else "no word of it" if "moons" in p else f"Query: tides, {last}" if "Keywords: tides" in p else last)
        return out

    got = {r.k: r.text for r in cv.rewritten(tasks, model).select("k", "text").collect()}
    assert got == {"one": "|user|: What is it?", "stale": "|user|: tides, why is that so", "no anchor": "|user|: why is that so", "lost": "|user|: Tell me of moons and why then", "empty": "|user|: "}


def test_document_chunks(spark):
    text = "Aa b. Cc d e f g.  Hh"
    docs = spark.createDataFrame([(1, text, "t"), (2, " \n", "A title"), (3, None, " "), (4, "x y z", None)], "k long, text string, title string")
    docs = docs.select("k", ck.titled(F.col("text"), F.col("title")).alias("text"))
    units = spark.createDataFrame([(1, 0, 0, 5, [1.0, 0.0]), (1, 1, 6, 17, [0.0, 1.0]), (1, 2, 19, 21, [0.0, 1.0])], "k long, i int, start int, end int, v array<double>")
    got = ck.document_chunks(docs, units, "k", "i", "v", size=4, overlap=1).collect()
    assert sorted((r.chunk_id, r.start, r.stop) for r in got) == [("1__c000000", 0, 5), ("1__c000001", 6, 14), ("1__c000002", 13, 21), ("2__c000000", 0, 7), ("4__c000000", 0, 5)]
    assert all(r.text == (text[r.start : r.stop] if r.k == 1 else {2: "A title", 4: "x y z"}[r.k]) for r in got)
