"""Queries of joins, windows, chunks, conversations and tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronlake.functions import text as tx
from heronlake.operators import chunking as ck
from heronlake.operators import conversations as cv
from heronlake.operators import corpus as cp
from heronlake.operators import ids
from heronlake.plans.registry import query
from heronlake.sources.scratch import table

C = F.col
W = Window
WS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def docs(s, d):
    return table(s, d, "documents")


def conv(s, d):
    return table(s, d, "conversations")


def tokens(s, d):
    return docs(s, d).select("doc_id", cp.words(C("text")).alias("t"))


# joins

CTX = "WITH c AS (SELECT conv_id, turn, unnest([conv_id, turn, 999999]) AS doc_id, generate_subscripts([1, 2, 3], 1) AS pos FROM conversations)"


@query("jn_attach_ctx", CTX + " SELECT conv_id, turn, string_agg(coalesce(d.text, '?'), '|' ORDER BY pos) AS texts, count(d.doc_id) AS hits FROM c LEFT JOIN documents d USING (doc_id) GROUP BY conv_id, turn")
def jn_attach_ctx(s, d):
    c = conv(s, d).select("conv_id", "turn", F.posexplode(F.array("conv_id", "turn", F.lit(999999).cast("long"))).alias("pos", "doc_id"))
    j = c.join(docs(s, d).select("doc_id", F.col("text").alias("x")), "doc_id", "left")
    g = j.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("x", F.lit("?")).alias("x")))).alias("a"), F.count("x").alias("hits"))
    return g.select("conv_id", "turn", F.array_join("a.x", "|").alias("texts"), "hits")


@query("jn_preds_ref", "SELECT d.doc_id, coalesce(b.text, '') AS prediction FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def jn_preds_ref(s, d):
    return docs(s, d).select("doc_id").join(table(s, d, "benchmark").select(C("item_id").alias("doc_id"), "text"), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("prediction"))


@query("jn_merge_back", "SELECT coalesce(d.doc_id, b.item_id) AS doc_id, coalesce(b.text, d.source) AS value, d.lang FROM documents d FULL JOIN benchmark b ON b.item_id = d.doc_id")
def jn_merge_back(s, d):
    b = table(s, d, "benchmark").select(C("item_id").alias("doc_id"), "text")
    return docs(s, d).select("doc_id", "source", "lang").join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("text", "source").alias("value"), "lang")


@query("jn_orig_order", "SELECT row_number() OVER (ORDER BY b.item_id) - 1 AS idx, b.item_id, coalesce(d.source, '') AS found FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 40")
def jn_orig_order(s, d):
    b = table(s, d, "benchmark").select("item_id", (C("item_id") * 40).alias("doc_id"), (F.row_number().over(W.orderBy("item_id")).cast("long") - 1).alias("idx"))
    return b.join(docs(s, d).select("doc_id", "source"), "doc_id", "left").select("idx", "item_id", F.coalesce("source", F.lit("")).alias("found")).orderBy("idx")


@query("jn_eval_input", "SELECT count(*) FILTER (l.doc_id IS NOT NULL AND b.item_id IS NOT NULL) AS joined, count(*) FILTER (l.doc_id IS NULL) AS no_gold, count(*) FILTER (l.doc_id IS NOT NULL AND b.item_id IS NULL) AS no_run FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def jn_eval_input(s, d):
    j = docs(s, d).select("doc_id").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").join(table(s, d, "benchmark").select(C("item_id").alias("doc_id"), F.lit(1).alias("b")), "doc_id", "left")
    g, r = C("quality").isNotNull(), C("b").isNotNull()
    return j.agg(F.count_if(g & r).alias("joined"), F.count_if(~g).alias("no_gold"), F.count_if(g & ~r).alias("no_run"))


@query("jn_csv_answers", "SELECT doc_id, CASE WHEN d.lang = 'en' THEN d.source ELSE b.text END AS answer FROM documents d JOIN benchmark b ON b.item_id = d.doc_id")
def jn_csv_answers(s, d):
    j = docs(s, d).join(table(s, d, "benchmark").select(C("item_id").alias("doc_id"), C("text").alias("answer")), "doc_id")
    return j.select("doc_id", F.when(C("lang") == "en", C("source")).otherwise(C("answer")).alias("answer"))


@query("jn_metric_csvs", "WITH k AS (SELECT user_id, arg_max(value, event_id) AS alg FROM events GROUP BY user_id) SELECT c_custkey, round(alg, 6) AS alg, quality, toxic FROM customer LEFT JOIN k ON user_id = c_custkey LEFT JOIN labels ON doc_id = c_custkey")
def jn_metric_csvs(s, d):
    k = cp.keep_last(table(s, d, "events").select(C("user_id").alias("c_custkey"), "event_id", F.round("value", 6).alias("alg")), "c_custkey", "event_id").drop("event_id")
    return table(s, d, "customer").select("c_custkey").join(k, "c_custkey", "left").join(table(s, d, "labels").withColumnRenamed("doc_id", "c_custkey"), "c_custkey", "left")


IDS = "WITH w AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'd_' || doc_id WHEN 1 THEN doc_id::VARCHAR WHEN 2 THEN 'x_d_' || doc_id ELSE 'none' || doc_id END AS id FROM documents), k AS (SELECT DISTINCT 'd_' || doc_id AS cand FROM documents), "


@query(
    "jn_fuzzy_docid",
    IDS + "c AS (SELECT id, cand, 1 AS m FROM w JOIN k ON id = cand UNION ALL SELECT id, cand, 2 FROM w JOIN k ON id = regexp_extract(cand, '^[^_]*_(.+)$', 1) UNION ALL SELECT id, cand, 3 FROM w JOIN k ON regexp_extract(id, '^[^_]*_(.+)$', 1) = cand),"
    " g AS (SELECT id, m, count(*) AS n, min(cand) AS cand FROM c GROUP BY id, m QUALIFY row_number() OVER (PARTITION BY id ORDER BY m) = 1)"
    " SELECT w.id, CASE WHEN n = 1 THEN cand END AS resolved, CASE WHEN g.id IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE ['exact', 'suffix', 'reverse_suffix'][m] END AS method FROM w LEFT JOIN g USING (id)",
)
def jn_fuzzy_docid(s, d):
    i, x = C("doc_id"), docs(s, d)
    wanted = x.select(F.when(i % 4 == 0, F.concat(F.lit("d_"), i)).when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, F.concat(F.lit("x_d_"), i)).otherwise(F.concat(F.lit("none"), i)).alias("id"))
    return ids.resolve_ids(wanted, x.select(F.concat(F.lit("d_"), i).alias("id")))


@query("jn_qid_base", "SELECT c.conv_id, c.turn, b.item_id FROM conversations c LEFT JOIN benchmark b ON b.item_id = c.conv_id")
def jn_qid_base(s, d):
    t = conv(s, d).select("conv_id", "turn", F.concat("conv_id", F.lit("<::>"), "turn").alias("task_id"))
    b = table(s, d, "benchmark").select("item_id", C("item_id").cast("string").alias("base"))
    return t.withColumn("base", ids.conversation_of(C("task_id"))).join(b, "base", "left").select("conv_id", "turn", "item_id")


SPANS = "WITH p AS (SELECT doc_id, i * 300 AS p_start, least((i + 1) * 300, n_chars) AS p_end FROM documents, unnest(generate_series(0, (n_chars - 1) // 300)) t(i)), c AS (SELECT doc_id, i * 448 AS c_start, least(i * 448 + 512, n_chars) AS c_end FROM documents, unnest(generate_series(0, (n_chars - 1) // 448)) t(i)), o AS (SELECT *, least(c_end, p_end) - greatest(c_start, p_start) AS overlap FROM c JOIN p USING (doc_id) WHERE p_start < c_end AND c_start < p_end)"


def span_tables(s, d):
    x = docs(s, d).select("doc_id", "n_chars")
    # an empty text has one piece, of no length; a sequence would run down from 0 to -1
    last = lambda step: F.expr(f"(n_chars - 1) div {step}")
    grid = lambda step: F.explode(F.when(last(step) >= 0, F.sequence(F.lit(0).cast("long"), last(step))))
    p = x.select("doc_id", "n_chars", grid(300).alias("i")).select("doc_id", (C("i") * 300).alias("p_start"), F.least((C("i") + 1) * 300, "n_chars").alias("p_end"))
    c = x.select("doc_id", "n_chars", grid(448).alias("i")).select("doc_id", (C("i") * 448).alias("c_start"), F.least(C("i") * 448 + 512, C("n_chars")).alias("c_end"))
    return c, p


@query("jn_span_overlap", SPANS + " SELECT doc_id, c_start, p_start, overlap FROM o")
def jn_span_overlap(s, d):
    return ck.overlaps(*span_tables(s, d), "doc_id").select("doc_id", "c_start", "p_start", "overlap")


@query("agg_leakage", SPANS + ", g AS (SELECT doc_id, c_start, count(*) AS n, max(overlap / (c_end - c_start)) AS best FROM o GROUP BY ALL) SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most, round(avg((n >= 2)::INT), 6) AS two, round(avg((n >= 3)::INT), 6) AS three, round(avg(best), 6) AS best FROM g")
def agg_leakage(s, d):
    g = ck.overlaps(*span_tables(s, d), "doc_id").groupBy("doc_id", "c_start").agg(F.count(F.lit(1)).alias("n"), F.max(C("overlap") / (C("c_end") - C("c_start"))).alias("best"))
    share = lambda k: F.round(F.avg((C("n") >= k).cast("int")), 6)
    return g.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", 0.95), 6).alias("p95"), F.max("n").alias("most"), share(2).alias("two"), share(3).alias("three"), F.round(F.avg("best"), 6).alias("best"))


@query("ret_chunk_to_passage", SPANS + " SELECT doc_id, p_start, round(max((c_start % 97) / 97.0::DOUBLE), 6) AS max, round(max((c_start % 97) / 97.0::DOUBLE * overlap / (c_end - c_start)), 6) AS max_overlap FROM o GROUP BY doc_id, p_start")
def ret_chunk_to_passage(s, d):
    o = ck.overlaps(*span_tables(s, d), "doc_id").withColumn("score", (C("c_start") % 97) / 97.0)
    return o.groupBy("doc_id", "p_start").agg(F.round(F.max("score"), 6).alias("max"), F.round(F.max(C("score") * C("overlap") / (C("c_end") - C("c_start"))), 6).alias("max_overlap"))


@query("agg_fragmentation", SPANS + ", g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS most FROM g")
def agg_fragmentation(s, d):
    g = span_tables(s, d)[0].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", 0.5), 6).alias("p50"), F.round(F.percentile("n", 0.99), 6).alias("p99"), F.max("n").alias("most"))


@query("agg_parent_group", SPANS + " SELECT doc_id, count(*) AS n, list_sort(list(c_start))[(round_even(0.9 * (count(*) - 1), 0) + 1)::BIGINT] AS p90 FROM c GROUP BY doc_id")
def agg_parent_group(s, d):
    """Nearest-rank percentile of each parent's offsets; ranks round half to even."""
    g = span_tables(s, d)[0].groupBy("doc_id").agg(F.sort_array(F.collect_list("c_start")).alias("a"))
    return g.select("doc_id", F.size("a").cast("long").alias("n"), F.element_at("a", (F.bround(F.lit(0.9) * (F.size("a") - 1), 0) + 1).cast("int")).alias("p90"))


@query("fn_parse_pid", "SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'plain' || doc_id WHEN doc_id % 3 = 1 THEN doc_id::VARCHAR ELSE doc_id || '_5-' || n_chars END AS parent, CASE doc_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 0 END::BIGINT AS start, CASE WHEN doc_id % 3 <> 2 THEN n_chars END AS \"end\", ['underscore_span', 'tail_pair', 'as_is'][doc_id % 3 + 1] AS method FROM documents")
def fn_parse_pid(s, d):
    i, n = C("doc_id"), C("n_chars")
    pid = F.when(i % 3 == 0, F.concat(i, F.lit("_5-"), n, F.lit("-0-9"))).when(i % 3 == 1, F.concat(i, F.lit("-0-"), n)).otherwise(F.concat(F.lit("plain"), i))
    return docs(s, d).select("doc_id", ids.parse_passage_id(pid).alias("p")).select("doc_id", "p.*")


# windows and chunks


@query("win_interval_union", "WITH i AS (SELECT l_orderkey AS k, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::BIGINT AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i), g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e) AS g FROM m) SELECT k, min(s)::BIGINT AS start, max(e) AS \"end\" FROM g GROUP BY k, g")
def win_interval_union(s, d):
    x = (C("l_linenumber") * 10).cast("long")
    return ck.union_intervals(table(s, d, "lineitem").select(C("l_orderkey").alias("k"), x.alias("start"), (x + C("l_quantity").cast("long")).alias("end")), "k")


FIXED = f"WITH t AS (SELECT doc_id, {WS} AS t FROM documents), w AS (SELECT doc_id, t, s FROM t, unnest(generate_series(0, len(t) - 1, 28)) x(s) WHERE len(t) > 0 AND (s = 0 OR s - 28 + 32 < len(t)))"


def fixed(s, d):
    return tokens(s, d).select("doc_id", "t", F.explode(ck.windows(C("t"), 32, 4)).alias("w")).select("doc_id", C("w.start").cast("long").alias("start"), C("w.end").cast("long").alias("end"), F.expr("array_join(slice(t, w.start + 1, w.end - w.start), ' ')").alias("text"))


@query("chk_fixed", FIXED + " SELECT doc_id, s AS start, least(s + 32, len(t))::BIGINT AS \"end\", array_to_string(t[s + 1:s + 32], ' ') AS text FROM w")
def chk_fixed(s, d):
    return fixed(s, d)


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
SPLIT = f"""WITH h AS (SELECT doc_id, half, CASE half WHEN 0 THEN t[1:(len(t) + 1) // 2] ELSE t[(len(t) + 1) // 2 + 1:] END AS t FROM (SELECT doc_id, {_WORDS} AS t FROM documents), (VALUES (0::BIGINT), (1::BIGINT)) x(half)),
p AS (SELECT doc_id, half, t, ln(1 + count(*)) AS w FROM (SELECT doc_id, half, unnest(t) AS t FROM h) GROUP BY ALL), q AS (SELECT item_id AS qid, t, ln(1 + count(*)) AS w FROM (SELECT item_id, unnest({_WORDS}) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, doc_id, half, sum(q.w * p.w) AS score FROM q JOIN p USING (t) GROUP BY ALL), c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id * 2 + half) <= 20)
SELECT qid, doc_id, round(max(score), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(max(score), 9) DESC, doc_id)::BIGINT AS rank FROM c GROUP BY qid, doc_id QUALIFY rank <= 10"""


@query("ret_split2", SPLIT)
def ret_split2(s, d):
    """Head and tail of each document are retrieved, twice as many as asked for, and taken to their documents by the best."""
    from heronlake.operators import retrieval as rt

    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    half = F.floor((F.size("t") + 1) / 2).cast("int")
    parts = docs(s, d).select("doc_id", words(C("text")).alias("t")).select("doc_id", F.posexplode(F.array(F.slice("t", F.lit(1), half), F.slice("t", half + 1, F.size("t")))).alias("half", "t"))
    parts = rt.postings(parts.select((C("doc_id") * 2 + C("half")).alias("doc_id"), "t"), "doc_id", C("t"))
    q = rt.postings(table(s, d, "benchmark").withColumnRenamed("item_id", "qid"), "qid", words(C("text")))
    best = rt.to_parents(rt.top(rt.sparse_scores(q, parts), 20), F.floor(C("doc_id") / 2).cast("long"))
    return rt.top(best, 10).select("qid", "doc_id", F.round("score", 6).alias("score"), C("rank").cast("long").alias("rank"))


SEG = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings), c AS (SELECT vec_id, label, list_cosine_similarity(p, v) AS cosine FROM e), g AS (SELECT *, sum(CASE WHEN cosine < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS segment FROM c)"


def segments(s, d):
    return ck.boundaries(table(s, d, "embeddings"), "label", "vec_id", "embedding", 0.0)


@query("win_adj_cosine", SEG + " SELECT vec_id, round(cosine, 6) AS cosine FROM c")
def win_adj_cosine(s, d):
    return segments(s, d).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query("win_segment_id", SEG + " SELECT label, segment::BIGINT AS segment, min(vec_id) AS first, max(vec_id) AS last, count(*) AS n FROM g GROUP BY label, segment")
def win_segment_id(s, d):
    return segments(s, d).groupBy("label", C("segment").cast("long").alias("segment")).agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.count(F.lit(1)).alias("n"))


SEMANTIC = r"""WITH n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS x FROM documents)),
e AS (SELECT doc_id, i, p, embedding::DOUBLE[] AS v FROM s, n JOIN embeddings ON vec_id = (doc_id * 7 + i // 3) % n),
c AS (SELECT *, list_cosine_similarity(lag(v) OVER (PARTITION BY doc_id ORDER BY i), v) AS cosine FROM e), g AS (SELECT *, sum(CASE WHEN cosine < 0.55 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM c),
t AS (SELECT doc_id, seg, list_filter(regexp_split_to_array(string_agg(p, ' ' ORDER BY i), '\s+'), lambda w: w <> '') AS t FROM g GROUP BY ALL),
w AS (SELECT doc_id, seg, t, s FROM t, unnest(generate_series(0, len(t) - 1, 320)) x(s) WHERE s = 0 OR s - 320 + 384 < len(t))
SELECT doc_id, doc_id || '__c' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY seg, s) - 1)::VARCHAR, 4, '0') AS chunk_id, array_to_string(t[s + 1:s + 384], ' ') AS text FROM w"""


@query("chk_semantic", SEMANTIC)
def chk_semantic(s, d):
    """Sentences (their vectors come from the table of vectors, three in a row have the same one) in segments, windows, ids."""
    p = F.split(F.regexp_replace(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), r"\n+", "\u0001"), "\u0001")
    p = F.filter(F.transform(p, lambda x: F.trim(x)), lambda x: x != "")
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    x = docs(s, d).select("doc_id", F.posexplode(p).alias("i", "p"))
    x = x.withColumn("vec_id", (C("doc_id") * 7 + F.floor(C("i") / 3)) % v.count()).join(v, "vec_id")
    return ck.semantic_chunks(x, "doc_id", "i", "p", "embedding")


@query("win_history", "SELECT conv_id, turn, string_agg(text, ' / ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS history FROM conversations".replace("string_agg(text, ' / ' ORDER BY turn) OVER", "array_to_string(list(text) OVER").replace("CURRENT ROW) AS", "CURRENT ROW), ' / ') AS"))
def win_history(s, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    return conv(s, d).select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), " / ").alias("history"))


LAST = "SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS last_user, string_agg('|' || role || '|: ' || text, chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id"
for _name in ("win_last_user", "qry_linearize"):

    @query(_name, LAST)
    def _linear(s, d):
        line = F.concat(F.lit("|"), "role", F.lit("|: "), "text")
        g = conv(s, d).groupBy("conv_id").agg(F.max_by(F.when(C("role") == "user", C("text")), F.when(C("role") == "user", C("turn"))).alias("last_user"), F.sort_array(F.collect_list(F.struct("turn", line.alias("x")))).alias("a"))
        return g.select("conv_id", "last_user", F.array_join("a.x", "\n").alias("whole"))


@query("win_recency_budget", f"WITH c AS (SELECT conv_id, turn, len({WS}) + 1 AS cost FROM conversations), r AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM c) SELECT conv_id, turn, total::BIGINT AS total FROM r WHERE total <= 120 OR r = 1")
def win_recency_budget(s, d):
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = conv(s, d).select("conv_id", "turn", (F.size(cp.words(C("text"))) + 1).alias("cost"))
    return c.withColumn("total", F.sum("cost").over(w)).withColumn("r", F.row_number().over(w)).where("total <= 120 OR r = 1").select("conv_id", "turn", "total")


@query("win_greedy_pack")
def win_greedy_pack(s, d):
    pieces = F.transform(ck.windows(C("t"), 32, 4), lambda w: F.struct(w["start"].cast("long").alias("at"), (w["end"] - w["start"]).cast("long").alias("n")))
    return ck.packed_rows(tokens(s, d).select("doc_id", pieces.alias("pieces")), "doc_id", "pieces", 128, 32)


for _name in ("win_budget_anchor", "chk_budget"):

    @query(_name)
    def _budget(s, d):
        total = tokens(s, d).select("doc_id", F.size("t").cast("long").alias("total"))
        return ck.budget_packs(fixed(s, d).select("doc_id", "start", "end").join(total, "doc_id"), "doc_id")


_CUT = r"""regexp_extract_all({q}, '\S+') AS w, regexp_extract_all({q}, '\s+') AS g"""
_LEN = "coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
_FROM = "beg + " + _LEN.format(x="w[1:s]") + " + " + _LEN.format(x="g[1:s]")
_TO = "beg + " + _LEN.format(x="w[1:least(s + {n}, len(w))]") + " + " + _LEN.format(x="g[1:least(s + {n}, len(w)) - 1]")
_STRIP = r"regexp_replace(regexp_replace(p, '^\s+', ''), '\s+$', '')"
#: Sentences with their offsets, cut to units of 128 words that share 16 (the table v).
UNITS = rf"""WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '\S') THEN text WHEN regexp_matches(coalesce(source, ''), '\S') THEN source END AS text FROM documents),
p AS (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2', 'g'), '(\n\n+)', chr(1) || '\1', 'g'), chr(1)) AS x FROM d)),
o AS (SELECT doc_id, k, {_STRIP} AS q, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(p) - length(regexp_replace(p, '^\s+', '')) AS beg FROM p),
t AS (SELECT doc_id, k, beg, {_CUT.format(q="q")} FROM o), u AS (SELECT * FROM t, unnest(generate_series(0, len(w) - 1, 112)) x(s) WHERE len(w) > 0 AND (s = 0 OR s - 112 + 128 < len(w))),
v AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, s) - 1 AS i, {_FROM} AS start, {_TO.format(n=128)} AS stop FROM u)"""
CHUNKS = UNITS + rf""", n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT doc_id, i, start, stop, embedding::DOUBLE[] AS v FROM v, n JOIN embeddings ON vec_id = (doc_id * 7 + i // 3) % n),
c AS (SELECT *, list_cosine_similarity(lag(v) OVER (PARTITION BY doc_id ORDER BY i), v) AS cosine FROM e), f AS (SELECT *, sum(CASE WHEN cosine < 0.55 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM c),
h AS (SELECT doc_id, seg, min(start) AS beg, max(stop) AS b FROM f GROUP BY ALL), m AS (SELECT h.*, substring(text, beg::BIGINT + 1, (b - beg)::BIGINT) AS z FROM h JOIN d USING (doc_id)),
y AS (SELECT doc_id, seg, beg, {_CUT.format(q="z")} FROM m), r AS (SELECT * FROM y, unnest(generate_series(0, len(w) - 1, 412)) x(s) WHERE s = 0 OR s - 412 + 512 < len(w)),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg, s) - 1 AS i, ({_FROM})::BIGINT AS start, ({_TO.format(n=512)})::BIGINT AS stop FROM r)
SELECT doc_id, doc_id || '__c' || lpad(i::VARCHAR, 6, '0') AS chunk_id, start, stop, substring(text, start + 1, stop - start) AS text FROM l JOIN d USING (doc_id)"""


@query("chk_units", UNITS + " SELECT doc_id, i::INT AS i, start::INT AS start, stop::INT AS stop FROM v")
def chk_units(s, d):
    """Sentences of a text with their offsets; longer ones are cut to windows of 128 words that share 16."""
    return units(docs_or_titles(s, d)).select("doc_id", "i", "start", C("end").alias("stop"))


def docs_or_titles(s, d):
    """Documents; one with a blank text has its source's name as text, as it has no other title."""
    return docs(s, d).select("doc_id", ck.titled(C("text"), C("source")).alias("text"))


def units(x):
    return x.select("doc_id", F.posexplode(ck.cut_spans(C("text"), tx.spans(C("text")), 128, 16)).alias("i", "p")).select("doc_id", "i", "p.start", "p.end")


@query("chk_doc_semantic", CHUNKS)
def chk_doc_semantic(s, d):
    """Units (their vectors come from the table of vectors, three in a row have the same one) in segments, windows, ids."""
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    x = docs_or_titles(s, d)
    u = units(x).withColumn("vec_id", (C("doc_id") * 7 + F.floor(C("i") / 3)) % v.count()).join(v, "vec_id")
    return ck.document_chunks(x, u, "doc_id", "i", "embedding")


# keywords and rewriting

KW = rf"list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\-]*'), lambda w: w NOT IN ({', '.join(repr(w) for w in tx.STOPWORDS)}) AND NOT regexp_matches(w, '^[0-9]+$'))"
TFIDF = f"WITH k AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest({KW}) AS w FROM documents) GROUP BY doc_id, w), f AS (SELECT w, count(*) AS df FROM k GROUP BY w), n AS (SELECT count(*) AS n FROM documents)"


def keyword_counts(s, d):
    k = docs(s, d).select("doc_id", F.explode(tx.keyword_tokens(C("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("tf"))
    return k.join(k.groupBy("w").agg(F.count(F.lit(1)).alias("df")), "w").withColumn("n", F.lit(docs(s, d).count()))


TERM = "(least(2.0, (length(w) - 3) * 0.15) + CASE WHEN regexp_matches(w, '[0-9]') THEN 0.6 ELSE 0 END + CASE WHEN contains(w, '-') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') THEN 0.6 ELSE 0 END)::DOUBLE"


@query("fn_keywords_tfidf", TFIDF + " SELECT doc_id, w AS token, round(tf * (ln((n + 1) / (df + 1)) + 1), 4) AS score FROM k JOIN f USING (w), n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * (ln((n + 1) / (df + 1)) + 1), 9) DESC, w) <= 8")
def fn_keywords_tfidf(s, d):
    k = keyword_counts(s, d).withColumn("x", C("tf") * (F.log((C("n") + 1) / (C("df") + 1)) + 1))
    w = W.partitionBy("doc_id").orderBy(F.round("x", 9).desc(), "w")
    return k.withColumn("r", F.row_number().over(w)).where("r <= 8").select("doc_id", C("w").alias("token"), F.round("x", 4).alias("score"))


@query("fn_keywords_doc", TFIDF + f", s AS (SELECT doc_id, w, tf, tf * (ln((n + 1) / (df + 1)) + 1) + 0.7::DOUBLE * {TERM} AS x FROM k JOIN f USING (w), n WHERE length(w) >= 3 AND df / n <= 0.02), c AS (SELECT doc_id, count(*) FILTER (tf >= 2) AS c FROM s GROUP BY doc_id) SELECT doc_id, w AS token, round(x, 4) AS score FROM s JOIN c USING (doc_id) WHERE c < 8 OR tf >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(x, 9) DESC, w) <= 12")
def fn_keywords_doc(s, d):
    k = keyword_counts(s, d).where((F.length("w") >= 3) & (C("df") / C("n") <= 0.02))
    k = k.withColumn("x", C("tf") * (F.log((C("n") + 1) / (C("df") + 1)) + 1) + F.lit(0.7) * tx.terminess(C("w")).cast("double"))
    k = k.withColumn("c", F.count_if(C("tf") >= 2).over(W.partitionBy("doc_id"))).where("c < 8 OR tf >= 2")
    w = W.partitionBy("doc_id").orderBy(F.round("x", 9).desc(), "w")
    return k.withColumn("r", F.row_number().over(w)).where("r <= 12").select("doc_id", C("w").alias("token"), F.round("x", 4).alias("score"))


QKW = r"WITH t AS (SELECT item_id, w, min(i) AS i, max(CASE WHEN regexp_matches(w, '[0-9]') THEN 3 ELSE 0 END + CASE WHEN length(w) >= 8 THEN 2 ELSE 0 END + CASE WHEN contains(w, '-') THEN 2 ELSE 0 END + CASE WHEN length(w) >= 4 THEN 1 ELSE 0 END)::BIGINT AS score FROM (SELECT item_id, unnest(k) AS w, generate_subscripts(k, 1) AS i FROM (SELECT item_id, " + KW + " AS k FROM benchmark)) GROUP BY item_id, w), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, w) AS r FROM t)"


def query_keywords(s, d):
    t = table(s, d, "benchmark").select("item_id", F.posexplode(tx.keyword_tokens(C("text"))).alias("i", "w")).groupBy("item_id", "w").agg(F.min("i").alias("i"))
    has = lambda cond, k: F.when(cond, k).otherwise(0)
    t = t.withColumn("score", (has(C("w").rlike("[0-9]"), 3) + has(F.length("w") >= 8, 2) + has(C("w").contains("-"), 2) + has(F.length("w") >= 4, 1)).cast("long"))
    return t.withColumn("r", F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "w"))).where("r <= 8")


@query("fn_keywords_query", QKW + " SELECT item_id, w AS token, score FROM r WHERE r <= 8")
def fn_keywords_query(s, d):
    return query_keywords(s, d).select("item_id", C("w").alias("token"), "score")


FILL = QKW + r""", f AS (SELECT item_id, list(w ORDER BY r) AS extra FROM r WHERE r <= 8 GROUP BY item_id), m AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{8,}') AS a FROM benchmark),
d AS (SELECT m.item_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a, coalesce(extra, []) AS extra FROM m LEFT JOIN f USING (item_id))
SELECT item_id, array_to_string(CASE WHEN len(a) < 8 THEN list_concat(a, list_filter(extra, lambda x: NOT list_contains(a, x)))[1:8] ELSE a[1:15] END, '; ') AS keywords FROM d"""


@query("qry_keywords_llm", FILL)
def qry_keywords_llm(s, d):
    """Keywords of a (stand-in) model, 15 at most; fewer than eight are filled up with the query's own."""
    from heronlake.functions import providers as pv

    extra = query_keywords(s, d).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("r", "w")))["w"].alias("extra"))
    m = pv.answered(table(s, d, "benchmark").select("item_id", F.lower("text").alias("prompt")), "prompt", pv.long_words)
    m = m.join(extra, "item_id", "left").withColumn("extra", F.coalesce("extra", F.array().cast("array<string>")))
    return m.select("item_id", F.array_join(cv.filled(F.split("answer", ", "), C("extra"), 8, 15), "; ").alias("keywords"))


@query("fn_keyword_query", QKW + " SELECT item_id, coalesce(string_agg(w, '; ' ORDER BY score DESC, w), text) AS value FROM benchmark LEFT JOIN (SELECT * FROM r WHERE r <= 8) USING (item_id) GROUP BY item_id, text")
def fn_keyword_query(s, d):
    g = query_keywords(s, d).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("r", "w"))).alias("a"))
    return table(s, d, "benchmark").join(g, "item_id", "left").select("item_id", F.coalesce(F.array_join("a.w", "; "), "text").alias("value"))


ANCHOR = rf"WITH u AS (SELECT conv_id, turn, {KW} AS k FROM conversations WHERE role = 'user'), l AS (SELECT conv_id, max(turn) AS last FROM u GROUP BY conv_id), c AS (SELECT u.conv_id, unnest(k) AS w FROM u JOIN l USING (conv_id) WHERE turn < last), g AS (SELECT c.conv_id, w, count(*) AS n FROM c GROUP BY ALL), z AS (SELECT u.conv_id, unnest(k) AS w FROM u JOIN l ON u.conv_id = l.conv_id AND turn = last) SELECT conv_id, w AS anchor FROM g WHERE (conv_id, w) NOT IN (SELECT conv_id, w FROM z) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, length(w) DESC, w) <= 3"


def anchors(s, d):
    """conv_id, w, r: the three commonest keywords of all but the last user's turn that aren't in that one."""
    u = conv(s, d).where("role = 'user'")
    # the last of all user turns, which may have no keyword
    last = u.groupBy("conv_id").agg(F.max("turn").alias("last"))
    k = u.select("conv_id", "turn", tx.keyword_tokens(C("text")).alias("k")).join(last, "conv_id").select("conv_id", "turn", "last", F.explode("k").alias("w"))
    g = k.groupBy("conv_id", "w").agg(F.count_if(C("turn") < C("last")).alias("n"), F.count_if(C("turn") == C("last")).alias("again")).where("n > 0 AND again = 0")
    w = W.partitionBy("conv_id").orderBy(F.desc("n"), F.length("w").desc(), "w")
    return g.withColumn("r", F.row_number().over(w)).where("r <= 3").select("conv_id", "w", "r")


@query("fn_anchors", ANCHOR)
def fn_anchors(s, d):
    return anchors(s, d).select("conv_id", C("w").alias("anchor"))


REWRITE = "WITH u AS (SELECT conv_id, text, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user') SELECT conv_id, CASE WHEN before IS NULL OR regexp_matches(text, '(?i)^\\s*(is|are|was|were|do|does|did|can|could|will|would|should)\\s') THEN text ELSE before || ' ' || text END AS value FROM u WHERE r = 1"


@query("fn_heuristic_rewrite", REWRITE)
def fn_heuristic_rewrite(s, d):
    w = W.partitionBy("conv_id")
    u = conv(s, d).where("role = 'user'").withColumn("before", F.lag("text").over(w.orderBy("turn"))).withColumn("r", F.row_number().over(w.orderBy(F.desc("turn")))).where("r = 1")
    return u.select("conv_id", cv.combined(C("text"), C("before")).alias("value"))


_LINE = r"""trim(coalesce(regexp_replace(regexp_replace(list_filter(list_transform(string_split({x}, chr(10)), lambda y: trim(y)), lambda y: y <> '' AND NOT regexp_matches(y, '^</?think>'))[1], '(?i)^(rewritten query|rewrite|query|answer)\s*:\s*', ''), '^["''`]+|["''`]+$', '', 'g'), ''))"""
_BAD = "(length(trim({x})) < 6 OR regexp_matches(trim({x}), '^[0-9]+$') OR regexp_matches(trim({x}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$') OR regexp_matches(lower({x}), '\\|(document|rank|score|relevance)\\|'))"
_NORM = r"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s''-]', '', 'g'), '\s+', ' ', 'g'))"
TWICE = ANCHOR.partition(" SELECT conv_id, w AS anchor")[0] + rf""", k AS (SELECT conv_id, w, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, length(w) DESC, w) AS r FROM g WHERE (conv_id, w) NOT IN (SELECT conv_id, w FROM z)),
a AS (SELECT conv_id, list(w ORDER BY r) AS anchors FROM k WHERE r <= 3 GROUP BY conv_id),
q AS (SELECT conv_id, list(trim(regexp_replace(text, '\s+', ' ', 'g')) ORDER BY turn) AS turns FROM conversations WHERE role = 'user' GROUP BY conv_id),
b AS (SELECT q.conv_id, turns, turns[-1] AS latest, coalesce(anchors, []) AS anchors, array_to_string(list_transform(turns, lambda x, i: '[' || i || '] ' || x), chr(10)) AS p1 FROM q LEFT JOIN a USING (conv_id)),
e AS (SELECT *, p1 || chr(10) || 'Keywords: ' || array_to_string(anchors, ', ') AS p2, CASE length(p1) % 3 WHEN 0 THEN '' WHEN 1 THEN latest ELSE latest || ' in detail' END AS m1 FROM b),
f AS (SELECT *, {_LINE.format(x="m1")} AS one, {_LINE.format(x="CASE WHEN length(p2) % 2 = 1 THEN latest ELSE anchors[1] || ' ' || latest END")} AS two FROM e),
h AS (SELECT *, len(turns) > 1 AND len(anchors) > 0 AND ({_BAD.format(x="one")} OR ({_NORM.format(x='one')} = {_NORM.format(x='latest')} AND NOT (regexp_matches(latest, '\?\s*$') AND NOT regexp_matches(latest, '(?i)(^|[^0-9A-Za-z_])({'|'.join(tx.PRONOUNS)})($|[^0-9A-Za-z_])') AND len(regexp_split_to_array(trim(latest), '\s+')) >= 4))) AS again FROM f),
o AS (SELECT *, CASE WHEN again AND NOT {_BAD.format(x="two")} AND len(list_filter(anchors, lambda x: contains(lower(two), lower(x)))) > 0 THEN two ELSE one END AS fin FROM h)
SELECT conv_id, '|user|: ' || trim(CASE WHEN {_BAD.format(x="fin")} THEN CASE WHEN len(turns) < 2 OR regexp_matches(latest, '(?i)^\s*(is|are|was|were|do|does|did|can|could|will|would|should)\s') THEN latest ELSE turns[-2] || ' ' || latest END ELSE fin END) AS text FROM o"""


@query("qry_rewrite", TWICE)
def qry_rewrite(s, d):
    """Queries rewritten by a (stand-in) model in two passes."""
    from heronlake.functions import providers as pv

    # white space as DuckDB has it: no vertical tab inside, all kinds of blanks at the ends
    t = F.regexp_replace(F.regexp_replace("text", r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+$", "")
    users = conv(s, d).where("role = 'user'").select("conv_id", "turn", t.alias("t"))
    turns = users.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]).alias("turns"))
    a = anchors(s, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]).alias("anchors"))
    done = cv.rewritten(turns.join(a, "conv_id", "left"), pv.rewriter)
    return done.select("conv_id", F.when(F.element_at("turns", -1).isNotNull(), C("text")).alias("text"))  # without a last text there is none


SENT = r"string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"
_KWP = KW.replace("text", "p")
GIST = f"""WITH tk AS (SELECT doc_id, unnest(kw) AS w, generate_subscripts(kw, 1) AS pl FROM (SELECT doc_id, {KW} AS kw FROM documents)),
kc AS (SELECT doc_id, w, count(*) AS n, min(pl) AS pl FROM tk GROUP BY ALL), kk AS (SELECT doc_id, list(w ORDER BY n DESC, pl)[1:8] AS kws FROM kc GROUP BY doc_id),
s AS (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(list_transform({SENT}, lambda x: trim(x)), lambda x: x <> '')[1:30] AS x FROM documents)),
sc AS (SELECT doc_id, p, i, {_KWP} AS ts, coalesce(kws, []) AS kws FROM s LEFT JOIN kk USING (doc_id)),
g AS (SELECT doc_id, CASE WHEN length(p) > 220 THEN regexp_replace(p[1:220], ' [^ ]*$', '') ELSE p END AS gist FROM sc
 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN len(ts) = 0 THEN -1.0 ELSE round(3 * len(list_filter(ts, lambda t: list_contains(kws, t))) + ln(1 + len(ts)), 9) END DESC, i) = 1)"""


def frequent_keywords(s, d, k: int = 8):
    """doc_id, kws: the k most frequent keywords, of equal ones the first."""
    x = docs(s, d).select("doc_id", F.posexplode(tx.keyword_tokens(C("text"))).alias("at", "w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    return x.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-C("n")).alias("n"), "at", "w"))), 1, k)["w"].alias("kws"))


def gist(s, d, most: int = 220):
    """doc_id, gist, kws: the sentence of most keywords (three points each) and words (their logarithm), cut at a blank."""
    x = docs(s, d).join(frequent_keywords(s, d), "doc_id", "left").select("doc_id", F.coalesce("kws", F.array().cast("array<string>")).alias("kws"), F.posexplode(tx.context_sentences(C("text"))).alias("i", "p"))
    x = x.withColumn("ts", tx.keyword_tokens(C("p")))
    hits = F.size(F.filter("ts", lambda t: F.array_contains("kws", t)))
    score = F.when(F.size("ts") == 0, -1.0).otherwise(F.round(3 * hits + F.log(F.size("ts") + 1.0), 9))
    best = x.withColumn("score", score).groupBy("doc_id").agg(F.max_by(F.struct("p", "kws"), F.struct("score", (-C("i")).alias("at"))).alias("b"))
    cut = F.when(F.length("b.p") > most, F.regexp_replace(F.substring("b.p", 1, most), " [^ ]*$", "")).otherwise(C("b.p"))
    return best.select("doc_id", cut.alias("gist"), "b.kws")


@query("fn_gist", GIST + " SELECT doc_id, gist FROM g")
def fn_gist(s, d):
    return gist(s, d).select("doc_id", "gist")


PREFIX = GIST + r""", l AS (SELECT d.doc_id, '[DOC] ' || source AS doc, CASE WHEN len(kws) > 0 THEN chr(10) || '[DOC_KW] ' || array_to_string(kws, '; ') ELSE '' END AS kw, coalesce(chr(10) || '[GIST] ' || gist, '') AS gs, coalesce(kws, []) AS kws, text
 FROM documents d LEFT JOIN kk USING (doc_id) LEFT JOIN g USING (doc_id)),
n AS (SELECT *, len(list_filter(regexp_split_to_array(doc || kw || gs, '\s+'), lambda w: w <> '')) AS n3, len(list_filter(regexp_split_to_array(doc || kw, '\s+'), lambda w: w <> '')) AS n2 FROM l)
SELECT doc_id, CASE WHEN n3 <= 10 THEN doc || kw || gs WHEN n2 <= 10 OR len(kws) = 0 THEN doc || kw ELSE doc || chr(10) || '[DOC_KW] ' || array_to_string(kws[1:greatest(3, floor(len(kws) * 10 / n2)::BIGINT)], '; ') END || chr(10) || '[TEXT]' || chr(10) || text AS value FROM n"""


@query("fn_ctx_prefix", PREFIX)
def fn_ctx_prefix(s, d, most: int = 10):
    """Document, keywords and gist before the text. A prefix of more than ``most`` words goes without the gist, and then with
    fewer keywords, three at least."""
    x = docs(s, d).join(gist(s, d), "doc_id", "left").withColumn("kws", F.coalesce("kws", F.array().cast("array<string>")))
    n_words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    named = lambda kws: F.concat(F.lit("\n[DOC_KW] "), F.array_join(kws, "; "))
    doc = F.concat(F.lit("[DOC] "), "source")
    short = F.concat(doc, F.when(F.size("kws") > 0, named("kws")).otherwise(""))
    full = F.concat(short, F.coalesce(F.concat(F.lit("\n[GIST] "), "gist"), F.lit("")))
    keep = F.greatest(F.lit(3), F.floor(F.size("kws") * most / n_words(short)).cast("int"))
    prefix = F.when(n_words(full) <= most, full).when((n_words(short) <= most) | (F.size("kws") == 0), short).otherwise(F.concat(doc, named(F.slice("kws", F.lit(1), keep))))
    return x.select("doc_id", F.concat(prefix, F.lit("\n[TEXT]\n"), "text").alias("value"))


# tasks

MODE = "WITH u AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS lastturn, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS questions FROM conversations GROUP BY conv_id)"


def tasks(s, d):
    user = C("role") == "user"
    g = conv(s, d).groupBy("conv_id").agg(F.max_by(F.when(user, C("text")), F.when(user, C("turn"))).alias("lastturn"), F.sort_array(F.array_compact(F.collect_list(F.when(user, F.struct("turn", "text"))))).alias("a"))
    return g.select("conv_id", "lastturn", F.when(F.size("a") > 0, F.array_join("a.text", " ")).alias("questions"))


@query("fn_question_mode", MODE + " SELECT u.conv_id, coalesce(b.text, lastturn, questions) AS question, CASE WHEN b.text IS NOT NULL THEN 'rewrite' WHEN lastturn IS NOT NULL THEN 'lastturn' WHEN questions IS NOT NULL THEN 'questions' END AS source FROM u LEFT JOIN benchmark b ON b.item_id = u.conv_id")
def fn_question_mode(s, d):
    t = tasks(s, d).join(table(s, d, "benchmark").select(C("item_id").alias("conv_id"), C("text").alias("rewrite")), "conv_id", "left")
    src = F.when(C("rewrite").isNotNull(), "rewrite").when(C("lastturn").isNotNull(), "lastturn").when(C("questions").isNotNull(), "questions")
    return t.select("conv_id", F.coalesce("rewrite", "lastturn", "questions").alias("question"), src.alias("source"))


#: Prompt styles by name; {q} and {d} are the question and the documents.
STYLES = {
    "plain": "{d}\nQuestion: {q}\nAnswer:",
    "grounded": "Use only the documents.\n{d}\nQuestion: {q}\nAnswer:",
    "concise": "Answer in one sentence.\n{d}\nQuestion: {q}\nAnswer:",
    "cited": "Cite documents by number.\n{d}\nQuestion: {q}\nAnswer:",
    "careful": "Say so if the documents do not tell.\n{d}\nQuestion: {q}\nAnswer:",
    "steps": "List what the documents say, then answer.\n{d}\nQuestion: {q}\nAnswer:",
    "dialogue": "You talk with a user.\n{d}\nUser: {q}\nYou:",
    "qa": "Question: {q}\n{d}\nAnswer:",
}
_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in STYLES.items()).replace("\n", "' || chr(10) || '")
PROMPT = MODE + f", s(style, template) AS (VALUES {_VALUES}) SELECT conv_id, style, replace(replace(template, '{{q}}', coalesce(lastturn, '')), '{{d}}', coalesce(d.text, '')) AS prompt FROM u LEFT JOIN documents d ON d.doc_id = u.conv_id, s"
@query("fn_prompt", PROMPT)
def fn_prompt(s, d):
    st = F.broadcast(s.createDataFrame(list(STYLES.items()), "style string, template string"))
    t = tasks(s, d).join(docs(s, d).select(C("doc_id").alias("conv_id"), "text"), "conv_id", "left").join(st)
    q = F.replace(C("template"), F.lit("{q}"), F.coalesce("lastturn", F.lit("")))
    return t.select("conv_id", "style", F.replace(q, F.lit("{d}"), F.coalesce("text", F.lit(""))).alias("prompt"))


REPORT = MODE + """, t AS (SELECT u.conv_id AS task_id, d.source AS domain, coalesce(b.text, lastturn, questions) AS question, CASE WHEN b.text IS NOT NULL THEN 'rewrite' WHEN lastturn IS NOT NULL THEN 'lastturn' WHEN questions IS NOT NULL THEN 'questions' END AS source
 FROM u LEFT JOIN benchmark b ON b.item_id = u.conv_id AND b.item_id % 2 = 0 LEFT JOIN documents d ON d.doc_id = u.conv_id * 3),
c AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY r) AS r, d.text[1:300] AS text FROM t, (VALUES (1), (2), (3), (4), (5)) x(r) JOIN documents d ON d.doc_id = task_id + r WHERE (task_id + r) % 3 <> 0 AND task_id % 10 <> 0 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY r) <= 2),
b AS (SELECT task_id, string_agg('[' || r || '] ' || text, chr(10) ORDER BY r) AS d FROM c GROUP BY task_id),
p AS (SELECT task_id, source, CASE WHEN domain IS NULL THEN 'no domain' WHEN coalesce(trim(question), '') = '' THEN 'no question' WHEN d IS NULL THEN 'empty contexts' ELSE 'written' END AS status, 'Use only the documents.' || chr(10) || coalesce(d, '') || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' AS prompt FROM t LEFT JOIN b USING (task_id))
SELECT 'prompt' AS kind, task_id, status AS name, prompt AS value FROM p WHERE status IN ('written', 'empty contexts') UNION ALL SELECT 'status', NULL, status, count(*)::VARCHAR FROM p GROUP BY status UNION ALL SELECT 'source', NULL, source, count(*)::VARCHAR FROM p WHERE status IN ('written', 'empty contexts') GROUP BY source"""


@query("rep_prompts", REPORT)
def rep_prompts(s, d):
    """Prompts of tasks with the first two contexts, and how many tasks were written, passed over, and asked in which way."""
    rewrites = table(s, d, "benchmark").where("item_id % 2 = 0").select(C("item_id").alias("conv_id"), C("text").alias("rewrite"))
    t = tasks(s, d).join(rewrites, "conv_id", "left").join(docs(s, d).where("doc_id % 3 = 0").select((C("doc_id") / 3).cast("long").alias("conv_id"), C("source").alias("domain")), "conv_id", "left")
    source = F.when(C("rewrite").isNotNull(), "rewrite").when(C("lastturn").isNotNull(), "lastturn").when(C("questions").isNotNull(), "questions")
    t = t.select(C("conv_id").alias("task_id"), "domain", F.coalesce("rewrite", "lastturn", "questions").alias("question"), source.alias("source"))
    c = t.where("task_id % 10 <> 0").select("task_id", F.explode(F.array(*[F.lit(r) for r in range(1, 6)])).alias("rank")).withColumn("doc_id", C("task_id") + C("rank")).where("doc_id % 3 <> 0")
    c = c.join(docs(s, d).select("doc_id", "text"), "doc_id")
    p = cv.prompts(t, c, STYLES["grounded"], 2, 300)
    done = p.where("prompt IS NOT NULL")
    rows = done.select(F.lit("prompt").alias("kind"), "task_id", C("status").alias("name"), C("prompt").alias("value"))
    for kind, of, name in (("status", p, "status"), ("source", done, "source")):
        n = of.groupBy(C(name).alias("name")).agg(F.count(F.lit(1)).cast("string").alias("value"))
        rows = rows.unionByName(n.select(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("task_id"), "name", "value"))
    return rows


TURNS = "SELECT conv_id, array_to_string(list(text ORDER BY turn)[:-2], ' / ') AS previous, arg_max(text, turn) AS current FROM conversations GROUP BY conv_id"


@query("fn_turns", TURNS)
def fn_turns(s, d):
    g = conv(s, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("a"))
    return g.select("conv_id", F.array_join(F.expr("slice(a.text, 1, size(a) - 1)"), " / ").alias("previous"), F.element_at("a.text", -1).alias("current"))


@query("fn_first_value", "SELECT doc_id, coalesce(CASE WHEN lang = 'xx' THEN lang END, nullif(CASE WHEN source = 'src1' THEN '' ELSE source END, ''), 'none') AS value FROM documents")
def fn_first_value(s, d):
    from heronlake.sources.schemas import first_present

    return docs(s, d).select("doc_id", F.coalesce(first_present(F.when(C("lang") == "xx", C("lang")), F.when(C("source") == "src1", "").otherwise(C("source"))), F.lit("none")).alias("value"))


BEIR = """WITH c AS (SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS asked,
 array_to_string(list('|' || role || '|: ' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), chr(10)) AS history FROM conversations),
g AS (SELECT conv_id, turn, asked, conv_id * 10 + turn + j AS d, CASE WHEN (conv_id + turn) % 3 <> 0 THEN (conv_id * 7 + turn + j) % 2 = 0 ELSE (conv_id + turn * 3 + j) % 4 = 0 END AS yes FROM c, (VALUES (0), (3)) x(j) WHERE role <> 'user' AND asked IS NOT NULL),
bad AS (SELECT conv_id, asked, turn FROM g GROUP BY ALL HAVING NOT bool_or(yes))
SELECT 'query' AS kind, conv_id || '_' || turn AS qid, history AS value FROM c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.conv_id = c.conv_id AND b.asked = c.turn)
UNION ALL SELECT 'qrel', conv_id || '_' || asked, 'd' || d FROM g WHERE yes"""


@query("qry_conv2beir", BEIR)
def qry_conv2beir(s, d):
    """Queries with three lines of history, and judgements by the editor's or else the author's feedback."""
    vote = lambda cond: F.when(cond, "yes").otherwise("no")
    i, n = C("conv_id"), C("turn")

    def context(j: int):
        author = F.create_map(F.lit("a"), vote((i + n * 3 + j) % 4 == 0))
        both = F.map_concat(author, F.create_map(F.lit("e"), vote((i * 7 + n + j) % 2 == 0)))
        return F.struct(F.concat(F.lit("d"), i * 10 + n + j).alias("document_id"), F.when((i + n) % 3 != 0, both).otherwise(author).alias("feedback"))

    m = conv(s, d).select("conv_id", "turn", "role", "text", F.lit("e").alias("editor"), F.lit("a").alias("author"), F.when(C("role") != "user", F.array(context(0), context(3))).alias("contexts"))
    q, r = cv.to_beir(m, 3)
    return q.select(F.lit("query").alias("kind"), "qid", C("text").alias("value")).unionByName(r.select(F.lit("qrel").alias("kind"), "qid", C("doc_id").alias("value")))


@query("rep_replace_ctx", CTX + " SELECT conv_id, turn, string_agg(doc_id || '=' || coalesce(d.text, ''), chr(10) ORDER BY pos) AS contexts, count(d.doc_id) AS found, count(*) - count(d.doc_id) AS missing, coalesce(string_agg(CASE WHEN d.doc_id IS NULL THEN c.doc_id::VARCHAR END, ',' ORDER BY pos), '') AS missing_ids FROM c LEFT JOIN documents d USING (doc_id) GROUP BY conv_id, turn".replace("string_agg(doc_id ||", "string_agg(c.doc_id ||"))
def rep_replace_ctx(s, d):
    """Each turn's contexts with their resolved texts, and which of them weren't found."""
    c = conv(s, d).select("conv_id", "turn", F.posexplode(F.array("conv_id", "turn", F.lit(999999).cast("long"))).alias("pos", "doc_id"))
    j = c.join(docs(s, d).select("doc_id", "text"), "doc_id", "left")
    g = j.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("pos", "doc_id", "text"))).alias("a"))
    shown = F.transform("a", lambda x: F.concat(x["doc_id"].cast("string"), F.lit("="), F.coalesce(x["text"], F.lit(""))))
    lost = F.filter("a", lambda x: x["text"].isNull())
    return g.select(
        "conv_id", "turn", F.array_join(shown, "\n").alias("contexts"), (F.size("a") - F.size(lost)).cast("long").alias("found"), F.size(lost).cast("long").alias("missing"),
        F.array_join(F.transform(lost, lambda x: x["doc_id"].cast("string")), ",").alias("missing_ids"),
    )
