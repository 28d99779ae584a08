"""Queries of corpus quality, validation, sets and statistics. Sources stand for domains, labelled documents for judged ones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronlake.functions import text as tx
from heronlake.operators import corpus as cp
from heronlake.plans.registry import query
from heronlake.sources.scratch import table

C = F.col
N = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"
n_words = lambda: F.size(cp.words(C("text")))
LANG = r"""WITH g AS (SELECT *, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 'unk' WHEN length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) / length(text) > 0.9 THEN 'en_like'
 WHEN regexp_matches(text, '[\x{0400}-\x{04FF}]') THEN 'ru_like' WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'zh_like' ELSE 'non_en_like' END AS tag FROM documents)"""
NORM = r"trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)" + r"Saving your location allows us to provide you with more relevant information|\bSet Location\b|Office of the Patient Advocate - State of California|^\s*[×x]\s*$" + r"')), ' '), '\s+', ' ', 'g'))"
DUP = f"WITH d AS (SELECT doc_id AS member, sha1({NORM}) AS h FROM documents), g AS (SELECT h, min(member) AS rep, count(*) AS count FROM d GROUP BY h HAVING count(*) >= 2), m AS (SELECT member, rep, count, member <> rep AND member NOT IN (SELECT doc_id FROM labels WHERE toxic = 0) AS drop FROM d JOIN g USING (h))"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def tagged(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("tag", tx.language(C("text"))["lang"])


def dups(spark, sf_dir):
    return cp.duplicate_groups(docs(spark, sf_dir), "doc_id", "text", labels(spark, sf_dir).where("toxic = 0").select("doc_id"))


def blacklist(spark, sf_dir):
    return dups(spark, sf_dir).where("drop").select(C("member").alias("doc_id"))


@query("flt_lang", LANG + " SELECT doc_id, source FROM g WHERE tag = 'en_like'")
def flt_lang(spark, sf_dir):
    return tagged(spark, sf_dir).where("tag = 'en_like'").select("doc_id", "source")


GROUPS = DUP + """ SELECT rep, any_value(count) AS count, count(*) FILTER (drop) AS dropped, count(*) FILTER (NOT drop AND member <> rep) AS protected,
 array_to_string(list_sort(list(member))[1:200], ',') AS members, (SELECT text[1:300] FROM documents x WHERE x.doc_id = rep) AS snippet FROM m GROUP BY rep"""


@query("agg_dedup_groups", GROUPS)
def agg_dedup_groups(spark, sf_dir):
    """Groups of equal texts: numbers of members, of dropped and of protected ones, the first 200 members, and how it begins."""
    return cp.group_report(dups(spark, sf_dir), docs(spark, sf_dir), "doc_id", "text")


@query("flt_blacklist", DUP + " SELECT source, count(*) FILTER (m.drop IS NULL OR NOT m.drop) AS kept, count(*) FILTER (m.drop) AS removed, round(count(*) FILTER (m.drop) / count(*), 6) AS ratio FROM documents LEFT JOIN m ON member = doc_id GROUP BY source")
def flt_blacklist(spark, sf_dir):
    kept, removed = cp.split_by(docs(spark, sf_dir).select("doc_id", "source"), blacklist(spark, sf_dir), "doc_id")
    both = kept.withColumn("k", F.lit(1)).unionByName(removed.withColumn("k", F.lit(0)))
    return both.groupBy("source").agg(F.count_if(C("k") == 1).alias("kept"), F.count_if(C("k") == 0).alias("removed"), F.round(F.count_if(C("k") == 0) / F.count(F.lit(1)), 6).alias("ratio"))


@query("flt_bad_passage", f"SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN {N} < 2 THEN 'too_short' END, CASE WHEN {N} > 850 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS reasons, text[1:300] AS snippet FROM documents WHERE {N} < 2 OR {N} > 850 OR trim(text) = ''")
def flt_bad_passage(spark, sf_dir):
    return cp.bad_passages(docs(spark, sf_dir), "text", n_words()).select("doc_id", F.array_join("reasons", ",").alias("reasons"), "snippet")


@query("flt_allow_qids", "SELECT item_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels)")
def flt_allow_qids(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").join(labels(spark, sf_dir).select(C("doc_id").alias("item_id")), "item_id", "left_semi").select("item_id")


@query("src_split_qids", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT item_id FROM benchmark)")
def src_split_qids(spark, sf_dir):
    return labels(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select(C("item_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "quality")


@query("val_task_ids", "SELECT coalesce(d.doc_id, l.item_id) AS id, CASE WHEN l.item_id IS NULL THEN 'missing' ELSE 'extra' END AS status FROM (SELECT doc_id FROM labels) d FULL JOIN benchmark l ON d.doc_id = l.item_id WHERE d.doc_id IS NULL OR l.item_id IS NULL")
def val_task_ids(spark, sf_dir):
    a, b = labels(spark, sf_dir).select(C("doc_id").alias("id")), table(spark, sf_dir, "benchmark").select(C("item_id").alias("id"))
    return a.join(b, "id", "left_anti").withColumn("status", F.lit("missing")).unionByName(b.join(a, "id", "left_anti").withColumn("status", F.lit("extra")))


@query("val_blacklist", DUP + ", x AS (SELECT source, m.drop IS NOT NULL AND m.drop AS black, l.doc_id IS NOT NULL AS judged, coalesce(l.quality, 0) >= 1 AS rel FROM documents d LEFT JOIN m ON member = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT coalesce(source, 'overall') AS source, count(*) FILTER (black) AS black, count(*) FILTER (black AND judged) AS judged, count(*) FILTER (black AND rel) AS relevant FROM x GROUP BY ROLLUP (source)")
def val_blacklist(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source").join(blacklist(spark, sf_dir).withColumn("black", F.lit(True)), "doc_id", "left").join(labels(spark, sf_dir), "doc_id", "left")
    black = F.coalesce("black", F.lit(False))
    g = d.rollup("source").agg(F.count_if(black).alias("black"), F.count_if(black & C("quality").isNotNull()).alias("judged"), F.count_if(black & (C("quality") >= 1)).alias("relevant"), F.grouping("source").alias("g"))
    return g.select(F.when(C("g") == 1, "overall").otherwise(C("source")).alias("source"), "black", "judged", "relevant")


@query("val_corpus", LANG + " SELECT count(*) FILTER (g.doc_id IS NULL) AS missing, count(*) FILTER (g.doc_id IS NULL AND quality = 1) AS missing_relevant, count(*) AS judged FROM labels l LEFT JOIN (SELECT doc_id FROM g WHERE tag = 'en_like') g USING (doc_id)")
def val_corpus(spark, sf_dir):
    kept = tagged(spark, sf_dir).where("tag = 'en_like'").select("doc_id", F.lit(1).alias("here"))
    j = labels(spark, sf_dir).join(kept, "doc_id", "left")
    return j.agg(F.count_if(C("here").isNull()).alias("missing"), F.count_if(C("here").isNull() & (C("quality") == 1)).alias("missing_relevant"), F.count(F.lit(1)).alias("judged"))


@query("val_overlap_guard", "SELECT count(*) AS n FROM (SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)")
def val_overlap_guard(spark, sf_dir):
    d = labels(spark, sf_dir)
    return d.where("quality = 0").select("doc_id").intersect(d.where("toxic = 1").select("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_lang_report", LANG + " SELECT tag, count(*) AS n, sum(strlen(text))::BIGINT AS bytes, list_sort(list(doc_id))[1:3]::VARCHAR AS examples FROM g GROUP BY tag")
def agg_lang_report(spark, sf_dir):
    d = tagged(spark, sf_dir).select("tag", "doc_id", F.octet_length("text").alias("b"))
    first = d.withColumn("r", F.row_number().over(Window.partitionBy("tag").orderBy("doc_id"))).where("r <= 3").groupBy("tag").agg(F.sort_array(F.collect_list("doc_id")).alias("e"))
    g = d.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("bytes")).join(first, "tag")
    return g.select("tag", "n", "bytes", F.concat(F.lit("["), F.array_join("e", ", "), F.lit("]")).alias("examples"))


@query("agg_lang_summary", LANG + ", s AS (SELECT g.source, count(*) AS total, count(*) FILTER (tag <> 'en_like') AS non_en, count(*) FILTER (tag <> 'en_like' AND l.quality = 1) AS hits FROM g LEFT JOIN labels l USING (doc_id) GROUP BY g.source) SELECT source, total, non_en, round(non_en / total, 6) AS share, hits, CASE WHEN hits = 0 THEN 'filter' ELSE 'keep' END AS suggestion FROM s")
def agg_lang_summary(spark, sf_dir):
    d = tagged(spark, sf_dir).join(labels(spark, sf_dir), "doc_id", "left")
    foreign = C("tag") != "en_like"
    g = d.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(foreign).alias("non_en"), F.count_if(foreign & (C("quality") == 1)).alias("hits"))
    return g.select("source", "total", "non_en", F.round(C("non_en") / C("total"), 6).alias("share"), "hits", F.when(C("hits") == 0, "filter").otherwise("keep").alias("suggestion"))


@query("jn_lang_qrels", LANG + " SELECT doc_id, tag FROM g WHERE tag <> 'en_like' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jn_lang_qrels(spark, sf_dir):
    return tagged(spark, sf_dir).where("tag <> 'en_like'").join(labels(spark, sf_dir).where("quality = 1"), "doc_id", "left_semi").select("doc_id", "tag")


STATS = "count(*) AS count, min(n)::BIGINT AS min, max(n)::BIGINT AS max, round(avg(n), 6) AS mean, " + ", ".join(f"round(quantile_cont(n, {p / 100}), 6) AS p{p}" for p in (10, 50, 90, 99)) + ", round(avg((n < 128)::INT) * 100, 6) AS under_128, round(avg((n >= 480)::INT) * 100, 6) AS from_480"


@query("agg_toklen_stats", f"SELECT lang, {STATS} FROM (SELECT lang, {N} AS n FROM documents) GROUP BY lang")
def agg_toklen_stats(spark, sf_dir):
    return cp.length_stats(docs(spark, sf_dir).select("lang", "text"), n_words(), ["lang"])


BIN = "CASE " + " ".join(f"WHEN n >= {a} AND n {'<=' if b == cp.BINS[-1] else '<'} {b} THEN '[{a},{b}{']' if b == cp.BINS[-1] else ')'}'" for a, b in zip(cp.BINS, cp.BINS[1:])) + " ELSE 'over' END"


@query("fn_bins", f"SELECT bin, count(*) AS count, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS pct FROM (SELECT {BIN} AS bin FROM (SELECT {N} AS n FROM documents)) GROUP BY bin")
def fn_bins(spark, sf_dir):
    return cp.histogram(docs(spark, sf_dir).select(n_words().alias("n")), C("n"))


@query("agg_toklen_domain", f"SELECT coalesce(source, 'overall') AS source, floor(quantile_cont(n, 0.5))::BIGINT AS p50, floor(quantile_cont(n, 0.99))::BIGINT AS p99, max(n)::BIGINT AS max FROM (SELECT source, {N} AS n FROM documents) GROUP BY GROUPING SETS ((source), ())")
def agg_toklen_domain(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", n_words().alias("n")).rollup("source")
    g = d.agg(F.floor(F.percentile("n", 0.5)).alias("p50"), F.floor(F.percentile("n", 0.99)).alias("p99"), F.max("n").cast("long").alias("max"), F.grouping("source").alias("g"))
    return g.select(F.when(C("g") == 1, "overall").otherwise(C("source")).alias("source"), "p50", "p99", "max")


@query("win_topn_group", f"SELECT source, doc_id, n::BIGINT AS n FROM (SELECT source, doc_id, {N} AS n FROM documents) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) <= 3")
def win_topn_group(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", "doc_id", n_words().cast("long").alias("n"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "doc_id"))).where("r <= 3").drop("r")


@query("tok_len", f"SELECT doc_id, {N}::BIGINT AS words, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::BIGINT AS alnum FROM documents")
def tok_len(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", n_words().cast("long").alias("words"), F.regexp_count("text", F.lit("[A-Za-z0-9]+")).cast("long").alias("alnum"))


@query("agg_tf", r"SELECT source, t AS token, count(*) AS tf FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents) GROUP BY source, t QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, t) <= 10")
def agg_tf(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("token")).groupBy("source", "token").agg(F.count(F.lit(1)).alias("tf"))
    return d.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("tf"), "token"))).where("r <= 10").drop("r")


@query("agg_sample", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (ORDER BY md5(doc_id || '|13'), doc_id) <= 100")
def agg_sample(spark, sf_dir):
    """100 documents by digest: a top-k, so no sort of all rows."""
    return docs(spark, sf_dir).select("doc_id", "source").orderBy(F.md5(F.concat("doc_id", F.lit("|13"))), "doc_id").limit(100)


@query("agg_clean_stats", r"SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')))::BIGINT AS blank, sum(len(regexp_extract_all(text, '[0-9A-Fa-f]{32,}')))::BIGINT AS hex_runs FROM documents GROUP BY source")
def agg_clean_stats(spark, sf_dir):
    lines = F.split("text", "\n")
    return docs(spark, sf_dir).groupBy("source").agg(F.sum(F.size(lines)).alias("lines"), F.sum(F.size(F.filter(lines, lambda x: F.trim(x) == ""))).alias("blank"), F.sum(F.regexp_count("text", F.lit("[0-9A-Fa-f]{32,}"))).alias("hex_runs"))


@query("win_keep_last", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def win_keep_last(spark, sf_dir):
    return cp.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("win_keep_first", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def win_keep_first(spark, sf_dir):
    return cp.keep_first(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("snk_csv_flat", "SELECT user_id, count(*) AS n, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def snk_csv_flat(spark, sf_dir):
    from heronlake.sources import io

    e = table(spark, sf_dir, "events")
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    d = cp.keep_last(e.select("user_id", "event_id", C("event_type").alias("last_type")), "user_id", "event_id").drop("event_id").join(n, "user_id")
    return io.csv_round_trip(d, "flat")


@query("set_ids_diff", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_ids_diff(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").exceptAll(labels(spark, sf_dir).select("doc_id"))


@query("set_pairs_diff", "WITH a AS (SELECT DISTINCT conv_id, role FROM conversations WHERE turn < 3), b AS (SELECT DISTINCT conv_id, role FROM conversations WHERE turn > 0) SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_b")
def set_pairs_diff(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a, b = c.where("turn < 3").select("conv_id", "role").distinct(), c.where("turn > 0").select("conv_id", "role").distinct()
    x = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["conv_id", "role"], "full_outer")
    return x.agg(F.count_if(C("b").isNull()).alias("only_a"), F.count_if(C("a").isNull()).alias("only_b"))


@query("set_dup_conflict", "SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def set_dup_conflict(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds")).where("kinds > 1")


@query("set_count", "SELECT count(*) FILTER (trim(text) <> '') AS n FROM documents")
def set_count(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.count_if(F.trim("text") != "").alias("n"))


@query("set_union_domains", "SELECT lang AS domain, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def set_union_domains(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(C("lang").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("lim_head", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def lim_head(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").orderBy("doc_id").limit(25)


@query("spl_split", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || '|5'), doc_id) AS r, greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.1)) AS n FROM documents) SELECT doc_id, source, CASE WHEN r <= n THEN 'valid' ELSE 'train' END AS split FROM r")
def spl_split(spark, sf_dir):
    w = Window.partitionBy("source")
    d = docs(spark, sf_dir).select("doc_id", "source")
    d = d.withColumn("r", F.row_number().over(w.orderBy(F.md5(F.concat("doc_id", F.lit("|5"))), "doc_id"))).withColumn("n", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * 0.1)))
    return d.select("doc_id", "source", F.when(C("r") <= C("n"), "valid").otherwise("train").alias("split"))
