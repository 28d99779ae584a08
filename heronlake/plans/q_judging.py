"""Queries of judge parsing and generation metrics.

Judges' outputs aren't among the tables, so they are made from document ids in the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions.text import harmonic
from heronlake.operators import judging as jd
from heronlake.plans.registry import query
from heronlake.sources.scratch import table

J = """WITH j AS (SELECT doc_id, text, source, n_chars,
 CASE doc_id % 6 WHEN 0 THEN 'Rating: [[' || (doc_id % 11) || ']]' WHEN 1 THEN 'Score: ' || (doc_id % 10) || '.5/10' WHEN 2 THEN 'none' WHEN 3 THEN 'Rating: [3] then [[' || (doc_id % 9) || ']]' WHEN 4 THEN 'Rating: 7' ELSE '' END AS judge,
 CASE doc_id % 5 WHEN 0 THEN 'Yes.' WHEN 1 THEN 'no, it answers' WHEN 2 THEN ' Partial' WHEN 3 THEN '42?' ELSE 'Maybe' END AS reply,
 CASE doc_id % 5 WHEN 0 THEN '["UNANSWERABLE"]' WHEN 1 THEN '[''PARTIAL'']' WHEN 2 THEN 'CONVERSATIONAL' WHEN 3 THEN 'ANSWERABLE' ELSE '' END AS cell,
 [CASE WHEN doc_id % 2 = 0 THEN 'supported' ELSE 'not_supported' END, CASE WHEN doc_id % 3 = 0 THEN 'unverifiable' ELSE 'supported' END, 'supported'] AS claims,
 (doc_id % 97) / 100.0::DOUBLE AS m FROM documents),
l AS (SELECT *, CASE WHEN starts_with(regexp_replace(lower(reply), '[^a-z]', '', 'g'), 'yes') THEN 'yes' WHEN starts_with(regexp_replace(lower(reply), '[^a-z]', '', 'g'), 'no') THEN 'no'
  WHEN starts_with(regexp_replace(lower(reply), '[^a-z]', '', 'g'), 'partial') THEN 'partial' ELSE 'parse_error' END AS label,
 CASE WHEN contains(upper(cell), 'CONVERSATIONAL') THEN 'conversational' WHEN contains(upper(cell), 'UNANSWERABLE') THEN 'unanswerable' WHEN contains(upper(cell), 'ANSWERABLE') OR contains(upper(cell), 'PARTIAL') THEN 'answerable_partial' ELSE 'unknown' END AS grp FROM j),
c AS (SELECT *, CASE grp WHEN 'answerable_partial' THEN CASE WHEN label IN ('no', 'partial') THEN m WHEN label = 'yes' THEN 0 END WHEN 'unanswerable' THEN CASE WHEN label = 'yes' THEN 1 WHEN label IN ('no', 'partial') THEN 0 END END AS cond FROM l)"""


def judged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    i = F.col("doc_id")
    pick = lambda n, *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (i % n + 1).cast("int"))
    d = d.withColumn("judge", pick(6, F.concat(F.lit("Rating: [["), i % 11, F.lit("]]")), F.concat(F.lit("Score: "), i % 10, F.lit(".5/10")), "none", F.concat(F.lit("Rating: [3] then [["), i % 9, F.lit("]]")), "Rating: 7", ""))
    d = d.withColumn("reply", pick(5, "Yes.", "no, it answers", " Partial", "42?", "Maybe")).withColumn("cell", pick(5, '["UNANSWERABLE"]', "['PARTIAL']", "CONVERSATIONAL", "ANSWERABLE", ""))
    d = d.withColumn("claims", F.array(F.when(i % 2 == 0, "supported").otherwise("not_supported"), F.when(i % 3 == 0, "unverifiable").otherwise("supported"), F.lit("supported")))
    d = d.withColumn("m", (i % 97) / 100.0).withColumn("label", jd.idk_label(F.col("reply"))).withColumn("grp", jd.eval_group(F.col("cell")))
    return d.withColumn("cond", jd.idk_condition(F.col("grp"), F.col("label"), F.col("m")))


C = F.col
VALUES = {
    "met_faith": (
        lambda: jd.faithfulness(C("claims")),
        "greatest(0, 1 - len(list_filter(claims, lambda x: x = 'not_supported')) / len(claims) - 0.5::DOUBLE * len(list_filter(claims, lambda x: x = 'unverifiable')) / len(claims))::DOUBLE",
    ),
    "met_idk_token": (lambda: jd.idk_token(C("reply")), "CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 3 THEN NULL ELSE 0.5 END::DOUBLE"),
    "met_idk_condition": (lambda: C("cond"), "cond::DOUBLE"),
    "met_idk_condition_official": (
        lambda: jd.idk_condition(C("grp"), C("label"), C("m"), "official"),
        "CASE WHEN grp IN ('unanswerable', 'conversational') THEN CASE WHEN label = 'yes' THEN 1 ELSE 0 END ELSE CASE WHEN label = 'yes' THEN 0 ELSE m END END::DOUBLE",
    ),
    "met_idk_correct": (
        lambda: jd.idk_correct(C("grp"), C("label")),
        "CASE grp WHEN 'answerable_partial' THEN (label IN ('no', 'partial'))::INT WHEN 'unanswerable' THEN (label = 'yes')::INT END::DOUBLE",
    ),
    "met_idk_judge_quality": (
        lambda: jd.judge_quality(C("grp"), C("label")),
        "CASE WHEN label = 'parse_error' THEN 0 WHEN grp IN ('unanswerable', 'conversational') THEN (label = 'yes')::INT WHEN grp = 'answerable_partial' THEN (label IN ('no', 'partial'))::INT END::DOUBLE",
    ),
    "met_rb_agg": (
        lambda: jd.rb_agg(C("m"), (C("doc_id") % 7) / 10.0, F.array(C("m") - 1, C("m") / 2)),
        "CASE WHEN doc_id % 7 > 0 THEN 3 / (1 / ((m + 1) / 2) + 1 / ((doc_id % 7) / 10.0::DOUBLE) + 1 / ((greatest(m - 1, m / 2) + 1) / 2)) ELSE 0 END::DOUBLE",
    ),
    "met_final": (lambda: harmonic(C("cond"), (C("m") + 1) / 2, F.lit(0.5)), "CASE WHEN cond IS NULL THEN NULL WHEN cond <= 0 THEN 0 ELSE 3 / (1 / cond + 1 / ((m + 1) / 2) + 2) END::DOUBLE"),
    "met_length": (lambda: F.length("text").cast("double"), "length(text)::DOUBLE"),
}
TEXTS = {
    "met_idk_label": (lambda: C("label"), "label"),
    "met_eval_group": (lambda: C("grp"), "grp"),
    "met_idk_norm": (
        lambda: jd.idk_norm(C("reply")),
        "CASE doc_id % 5 WHEN 0 THEN 'yes.' WHEN 2 THEN 'partial' ELSE lower(trim(reply)) END",
    ),
}
for _names, _rounded in ((VALUES, True), (TEXTS, False)):
    for _name, (_f, _sql) in _names.items():

        def _run(spark, sf_dir, f=_f, rounded=_rounded):
            v = f()
            return judged(spark, sf_dir).select("doc_id", (F.round(v, 6) if rounded else v).alias("value"))

        query(_name, J + f" SELECT doc_id, {f'round({_sql}, 6)' if _rounded else _sql} AS value FROM c")(_run)


#: Answers in all the forms in which judges rate, from the document's id, in Spark and in SQL.
ANSWERS = """WITH a AS (SELECT doc_id, (doc_id % 13)::VARCHAR AS k FROM documents),
f AS (SELECT doc_id, CASE doc_id % 18 WHEN 0 THEN 'Rating: [[' || k || ']]' WHEN 1 THEN 'score: ' || k || '.5/10' WHEN 2 THEN 'none' WHEN 3 THEN 'Rating: [3] then [[' || k || ']]'
  WHEN 4 THEN 'rating: ' || k WHEN 5 THEN '' WHEN 6 THEN 'I say [' || k || '].' WHEN 7 THEN 'OVERALL rating: 6.5 and [2]' WHEN 8 THEN k || ' OUT of 10' WHEN 9 THEN '[Rating]' || chr(10) || k
  WHEN 10 THEN 'Rating: [[' || k || '/10]]' WHEN 11 THEN 'Rating: [[' || k WHEN 12 THEN 'For example: Rating: [[2]]' || chr(10) || 'Score: ' || k WHEN 13 THEN 'Rating: [[8.5]]' WHEN 14 THEN 'Rating: 10, then [[4]]'
  WHEN 15 THEN '-3 out of 10' WHEN 16 THEN '{"rating": 0.' || k || ', "why": "x"}' ELSE '{"rb_llm": ' || k || '}' END AS t FROM a)"""


def answers(spark, sf_dir):
    k, nl = (F.col("doc_id") % 13).cast("string"), "\n"
    forms = [("Rating: [[", k, "]]"), ("score: ", k, ".5/10"), ("none",), ("Rating: [3] then [[", k, "]]"), ("rating: ", k), ("",), ("I say [", k, "]."), ("OVERALL rating: 6.5 and [2]",), (k, " OUT of 10"),
             (f"[Rating]{nl}", k), ("Rating: [[", k, "/10]]"), ("Rating: [[", k), (f"For example: Rating: [[2]]{nl}Score: ", k), ("Rating: [[8.5]]",), ("Rating: 10, then [[4]]",), ("-3 out of 10",),
             ('{"rating": 0.', k, ', "why": "x"}'), ('{"rb_llm": ', k, "}")]
    made = F.array(*[F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in f]) for f in forms])
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(made, (F.col("doc_id") % 18 + 1).cast("int")).alias("t"))


_X = r"regexp_replace(t, '(?im)for example:.*?$', '', 'g')"
STATED = "coalesce(" + ", ".join(
    f"try_cast(nullif(regexp_extract({_X}, '{p}', 1), '') AS DOUBLE)"
    for p in (
        r"(?i)([-+]?\d*\.?\d+) out of 10", r"(?i)Rating: \[\[([-+]?\d*\.?\d+)", r"(?i)Rating: \[\[(\d+)/10\]\]", r"(?i)\[Rating\]\n(\d+)", r"(?i)Score: ([0-9]*\.?[0-9]+)", r"(?i)Score: ([0-9]*\.?[0-9]+)/10",
        r"(?i)Overall Rating: ([0-9]*\.?[0-9]+)", r"(?i)Rating: \[\[([0-9]*\.?[0-9]+)\]\]", r"(?i)\[(\d+)\]", r"(?i)\[\[(\d+)\]\]", r"(?i)Rating: (\d+)", r"(?i)Rating: \[\[(\d+)\]\]",
    )
) + ") / 10"
RATED = ANSWERS + f", r AS (SELECT *, {STATED} AS s FROM f), v AS (SELECT *, CASE WHEN s > 0 AND s <= 1 THEN s ELSE 0.5 END AS value FROM r)"


@query("met_rating", RATED + " SELECT doc_id, round(value, 6)::DOUBLE AS value FROM v")
def met_rating(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", F.round(jd.rating(C("t")), 6).alias("value"))


@query("met_rating_fb", RATED + """, j AS (SELECT *, CASE WHEN t LIKE '{%' THEN coalesce(try_cast(json_extract_string(t, '$.rating') AS DOUBLE), try_cast(json_extract_string(t, '$.score') AS DOUBLE), try_cast(json_extract_string(t, '$.RB_llm') AS DOUBLE), try_cast(json_extract_string(t, '$.rb_llm') AS DOUBLE)) END AS js FROM v)
SELECT doc_id, CASE WHEN t = '' THEN 'EMPTY_ANSWER' WHEN js IS NULL AND s IS NULL THEN 'PARSE_ERROR' ELSE 'OK' END AS code,
 round(CASE WHEN t = '' THEN 0.0 WHEN js IS NOT NULL THEN greatest(0, least(1, js)) WHEN s IS NULL THEN 0.5 ELSE value END, 6)::DOUBLE AS score FROM j""")
def met_rating_fb(spark, sf_dir):
    r = answers(spark, sf_dir).select("doc_id", jd.rating_or_code(C("t")).alias("r"))
    return r.select("doc_id", "r.code", F.round("r.score", 6).alias("score"))


@query("prd_needs_hist", J + " SELECT doc_id, contains(upper(cell), 'UNANSWERABLE') OR contains(upper(cell), 'CONVERSATIONAL') AS value FROM j")
def prd_needs_hist(spark, sf_dir):
    cells = F.array(C("cell"))
    return judged(spark, sf_dir).select("doc_id", F.exists(cells, lambda x: F.lower(x).contains("unanswerable") | F.lower(x).contains("conversational")).alias("value"))


@query(
    "agg_idk_summary",
    J + " SELECT grp, count(*) AS n, round(avg(m), 6) AS raw, round(avg(cond), 6) AS conditioned, count(*) FILTER (label = 'yes') AS refused FROM c GROUP BY grp UNION ALL SELECT 'main', count(*), round(avg(m), 6), round(avg(cond), 6), count(*) FILTER (label = 'yes') FROM c WHERE grp IN ('answerable_partial', 'unanswerable')",
)
def agg_idk_summary(spark, sf_dir):
    d = judged(spark, sf_dir)
    tagged = d.select(F.explode(F.when(C("grp").isin("answerable_partial", "unanswerable"), F.array("grp", F.lit("main"))).otherwise(F.array("grp"))).alias("grp"), "m", "cond", "label")
    return tagged.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 6).alias("raw"), F.round(F.avg("cond"), 6).alias("conditioned"), F.count_if(C("label") == "yes").alias("refused"))


@query("agg_crosstab", J + " SELECT coalesce(grp, 'All') AS grp, coalesce(label, 'All') AS label, count(*) AS n FROM c GROUP BY CUBE (grp, label)")
def agg_crosstab(spark, sf_dir):
    d = judged(spark, sf_dir).cube("grp", "label").agg(F.count(F.lit(1)).alias("n"), F.grouping("grp").alias("a"), F.grouping("label").alias("b"))
    return d.select(F.when(C("a") == 1, "All").otherwise(C("grp")).alias("grp"), F.when(C("b") == 1, "All").otherwise(C("label")).alias("label"), "n")


@query("agg_label_counts", J + " SELECT label, count(*) AS n, round(avg(m), 6) AS mean FROM c GROUP BY label")
def agg_label_counts(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("m"), 6).alias("mean"))


@query("agg_domain_mean", J + " SELECT source, round(avg(m), 6) AS mean FROM c GROUP BY source ORDER BY mean DESC")
def agg_domain_mean(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("source").agg(F.round(F.avg("m"), 6).alias("mean")).orderBy(F.desc("mean"))


@query("agg_median_judges", J + " SELECT doc_id, round(list_median([m, coalesce(cond, 0.5)::DOUBLE, 0.3::DOUBLE]), 6) AS value FROM c".replace("list_median([m, coalesce(cond, 0.5)::DOUBLE, 0.3::DOUBLE])", "list_sort([m, coalesce(cond, 0.5)::DOUBLE, 0.3::DOUBLE])[2]"))
def agg_median_judges(spark, sf_dir):
    votes = judged(spark, sf_dir).select("doc_id", F.explode(F.array("m", F.coalesce("cond", F.lit(0.5)), F.lit(0.3))).alias("v"))
    return votes.groupBy("doc_id").agg(F.round(F.median("v"), 6).alias("value"))


@query(
    "agg_prompt_variants",
    J + ", r AS (SELECT 'a' AS run, doc_id, grp, m AS x, cond AS y FROM c UNION ALL SELECT 'b', doc_id, grp, 1 - m, m FROM c) SELECT run, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) FILTER (y IS NULL) AS missing, round(avg(x) FILTER (grp = 'answerable_partial'), 6) AS answerable, round(2 / (1 / avg(x) + 1 / avg(y)), 6) AS hm_of_means FROM r GROUP BY run",
)
def agg_prompt_variants(spark, sf_dir):
    d = judged(spark, sf_dir)
    r = d.select(F.lit("a").alias("run"), "grp", C("m").alias("x"), C("cond").alias("y")).unionByName(d.select(F.lit("b").alias("run"), "grp", (1 - C("m")).alias("x"), C("m").alias("y")))
    g = r.groupBy("run").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count_if(C("y").isNull()).alias("missing"), F.round(F.avg(F.when(C("grp") == "answerable_partial", C("x"))), 6).alias("answerable"))
    return g.select("run", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "missing", "answerable", F.round(2 / (1 / C("x") + 1 / C("y")), 6).alias("hm_of_means"))


@query("jn_judges_outer", J + ", a AS (SELECT doc_id, label FROM c WHERE n_chars > 1000), b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN label ELSE 'yes' END AS label FROM c WHERE n_chars < 3000) SELECT doc_id, a.label AS label_a, b.label AS label_b FROM a FULL JOIN b USING (doc_id) WHERE a.label IS DISTINCT FROM b.label")
def jn_judges_outer(spark, sf_dir):
    d = judged(spark, sf_dir)
    a = d.where("n_chars > 1000").select("doc_id", C("label").alias("label_a"))
    b = d.where("n_chars < 3000").select("doc_id", F.when(C("doc_id") % 2 == 0, C("label")).otherwise("yes").alias("label_b"))
    return a.join(b, "doc_id", "full_outer").where(~C("label_a").eqNullSafe(C("label_b")))


PAIRS = """WITH p AS (SELECT a.conv_id * 1000 + a.turn AS k, a.text AS pred, b.text AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1),
n AS (SELECT k, list_filter(regexp_split_to_array(trim(regexp_replace(translate(lower(pred), '{p}', ''), '\\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')) AS a,
 list_filter(regexp_split_to_array(trim(regexp_replace(translate(lower(target), '{p}', ''), '\\s+', ' ', 'g')), ' '), lambda w: w NOT IN ('', 'a', 'an', 'the')) AS b FROM p),
x AS (SELECT k, t, count(*) AS c FROM (SELECT k, unnest(a) AS t FROM n) GROUP BY ALL), y AS (SELECT k, t, count(*) AS c FROM (SELECT k, unnest(b) AS t FROM n) GROUP BY ALL),
o AS (SELECT k, sum(least(x.c, y.c)) AS o FROM x JOIN y USING (k, t) GROUP BY k)
SELECT k, round(CASE WHEN len({of}) > 0 THEN coalesce(o, 0) / len({of}) ELSE 0 END, 6) AS value FROM n LEFT JOIN o USING (k)"""


def pairs(spark, sf_dir):
    """Each turn as a prediction for the turn before it."""
    c = table(spark, sf_dir, "conversations")
    b = c.select("conv_id", (C("turn") + 1).alias("turn"), C("text").alias("target"))
    return c.join(b, ["conv_id", "turn"]).select((C("conv_id") * 1000 + C("turn")).alias("k"), C("text").alias("pred"), "target")


for _name, _col, _of in (("met_token_recall", "recall", "b"), ("met_token_precision", "precision", "a")):

    def _overlap(spark, sf_dir, col=_col):
        return jd.token_overlap(pairs(spark, sf_dir), "k", C("pred"), C("target")).select("k", F.round(col, 6).alias("value"))

    from heronlake.functions.text import PUNCTUATION

    query(_name, PAIRS.replace("{p}", PUNCTUATION.replace("'", "''")).replace("{of}", _of))(_overlap)


@query("met_rouge_l")
def met_rouge_l(spark, sf_dir):
    return jd.rouge_l(pairs(spark, sf_dir), "k", C("pred"), C("target")).select("k", F.round("rouge_l", 6).alias("value"))


@query("met_extractive")
def met_extractive(spark, sf_dir):
    return jd.extractive(pairs(spark, sf_dir), "k", C("pred"), C("target")).select("k", F.round("value", 6).alias("value"))


#: Metrics as a configuration file lists them; the names are fixed values.
CONFIG = """
Recall:
  func: recall
  prediction: prediction
  target: target
RougeL_stemFalse:
  func: rouge_l
  prediction: prediction
  target: target
BertscoreP:
  func: bert_prec
  prediction: prediction
  target: target
BertscoreR:
  func: bert_recall
  prediction: prediction
  target: target
BertKPrec:
  func: bert_prec
  prediction: prediction
  target: passage
Extractiveness_RougeL:
  func: extractiveness_rouge
  prediction: prediction
  target: passage
Length:
  func: length
  prediction: prediction
  target: target
"""


@query("met_dispatch")
def met_dispatch(spark, sf_dir, config=CONFIG):
    """Each turn as a prediction for two targets, the turn before and itself, with the text of the document of the conversation's
    number as its passage, if there is one."""
    d = table(spark, sf_dir, "documents").select((C("doc_id")).alias("conv"), C("text").alias("passage"))
    t = pairs(spark, sf_dir).withColumn("conv", F.floor(C("k") / 1000)).join(d, "conv", "left")
    t = t.select("k", C("pred").alias("prediction"), F.array("target", "pred").alias("targets"), F.array_compact(F.array("passage")).alias("passages"))
    out = jd.dispatch(t, "k", jd.metric_config(config))
    return out.select("k", "metric", F.posexplode("values").alias("i", "value")).select("k", "metric", "i", F.round("value", 6).alias("value"))


@query("agg_ppl", "SELECT source, round(exp(sum(n_chars * 0.001::DOUBLE) / sum(n_chars * 0.0004::DOUBLE + 1)), 6) AS corpus, round(avg(exp(n_chars * 0.001::DOUBLE / (n_chars * 0.0004::DOUBLE + 1))), 6) AS mean, round(quantile_cont(exp(n_chars * 0.001::DOUBLE / (n_chars * 0.0004::DOUBLE + 1)), 0.9), 6) AS p90 FROM documents GROUP BY source")
def agg_ppl(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", (C("n_chars") * 0.001).alias("nll"), (C("n_chars") * 0.0004 + 1).alias("tok"))
    each = F.exp(C("nll") / C("tok"))
    return d.groupBy("source").agg(F.round(F.exp(F.sum("nll") / F.sum("tok")), 6).alias("corpus"), F.round(F.avg(each), 6).alias("mean"), F.round(F.percentile(each, 0.9), 6).alias("p90"))
