"""Queries of readers, writers, providers and incremental work. Tables are written in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions import providers as pv
from heronlake.operators import judging as jd
from heronlake.plans.registry import query
from heronlake.sources import io
from heronlake.sources.scratch import scratch, table
from heronlake.streaming import incremental as inc

C = F.col
DOCS = "SELECT * FROM documents"


@query("src_jsonl", DOCS)
def src_jsonl(s, d):
    return io.jsonl_round_trip(table(s, d, "documents"), "jsonl")


@query("src_gz", DOCS)
def src_gz(s, d):
    return io.jsonl_round_trip(table(s, d, "documents"), "gz", "gzip")


@query("snk_jsonl", "SELECT * FROM benchmark")
def snk_jsonl(s, d):
    return io.jsonl_round_trip(table(s, d, "benchmark"), "snk")


@query("src_zip", "SELECT item_id, text FROM benchmark")
def src_zip(s, d):
    """Zip archives of 50 items each, written and read by their member."""
    path = scratch(s, "zip")
    lines = table(s, d, "benchmark").groupBy(F.floor(C("item_id") / 50).alias("name")).agg(F.collect_list(F.to_json(F.struct("item_id", "text"))).alias("lines"))
    io.write_zips(lines, path, "queries.jsonl")
    return io.read_zip(s, f"{path}/*.zip", "queries.jsonl", "item_id long, text string")


QRELS = "SELECT 'q' || (doc_id % 40) AS qid, 'd' || doc_id AS doc_id, quality AS rel FROM labels"


def qrels(s, d):
    return table(s, d, "labels").select(F.concat(F.lit("q"), C("doc_id") % 40).alias("query-id"), F.concat(F.lit("d"), "doc_id").alias("corpus-id"), C("quality").alias("score"))


@query("src_qrels_beir", QRELS)
def src_qrels_beir(s, d):
    path = scratch(s, "qrels")
    qrels(s, d).write.option("header", True).option("sep", "\t").csv(path)
    return io.read_qrels(s, path)


@query("snk_beir", "SELECT 'c' || (doc_id % 40 % 3) AS collection, 'q' || (doc_id % 40) AS qid, 'd' || doc_id AS doc_id, quality AS rel, 'question ' || (doc_id % 40) AS text FROM labels")
def snk_beir(s, d):
    """Queries and judgements of three collections, written to folders of their own and read again."""
    base, q = scratch(s, "beir"), qrels(s, d)
    of = F.concat(F.lit("c"), F.substring("query-id", 2, 99).cast("long") % 3)
    asked = q.select("query-id").distinct().select(of.alias("collection"), C("query-id").alias("_id"), F.concat(F.lit("question "), F.substring("query-id", 2, 99)).alias("text"))
    io.write_beir(asked, q.withColumn("collection", of), base)
    judged = None
    for c in ("c0", "c1", "c2"):
        one = io.read_qrels(s, f"{base}/qrels/collection={c}").withColumn("collection", F.lit(c))
        judged = one if judged is None else judged.unionByName(one)
    read = io.read_jsonl(s, f"{base}/queries", "_id string, text string, collection string").withColumnRenamed("_id", "qid")
    return judged.join(read, ["collection", "qid"])


@query("src_qrels_any", QRELS + " WHERE quality >= 1")
def src_qrels_any(s, d):
    """Lines with tabs, with blanks and a 0, JSON objects, JSON lists, and objects of objects, in one file."""
    path, q = scratch(s, "any"), qrels(s, d)
    n = F.substring("corpus-id", 2, 99).cast("long")
    line = F.when(n % 5 == 0, F.concat_ws("\t", "query-id", "corpus-id", "score")).when(n % 5 == 1, F.concat_ws(" ", "query-id", F.lit("0"), "corpus-id", "score")).otherwise(F.to_json(F.struct("query-id", "corpus-id", "score")))
    lines = q.where(n % 5 <= 2).select(line.alias("value")).unionByName(s.createDataFrame([("query-id\tcorpus-id\tscore",)], "value string"))
    lists = q.where(n % 5 == 3).groupBy(F.floor(n / 50)).agg(F.to_json(F.collect_list(F.struct("query-id", "corpus-id", "score"))).alias("value")).select("value")
    own = q.where(n % 5 == 4).groupBy("query-id", F.floor(n / 50)).agg(F.map_from_entries(F.collect_list(F.struct("corpus-id", "score"))).alias("m"))
    maps = own.select(F.to_json(F.create_map("query-id", "m")).alias("value"))
    lines.unionByName(lists).unionByName(maps).write.text(path)
    return io.read_qrels_any(s, path)


RUN = "SELECT c.conv_id::VARCHAR AS qid, 'd' || c.turn AS doc_id, (100 - turn)::DOUBLE AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS rank FROM conversations c"


@query("src_run", RUN)
def src_run(s, d):
    path = scratch(s, "run")
    g = table(s, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("d"), "turn").alias("document_id"), (100.0 - C("turn")).alias("score")))).alias("a"))
    pairs = F.transform("a", lambda x: F.struct(x["document_id"].alias("document_id"), x["score"].alias("score")))
    kind = C("conv_id") % 3
    rows = g.select(
        C("conv_id").cast("string").alias("task_id"), F.when(kind == 0, pairs).alias("contexts"), F.when(kind == 1, pairs).alias("documents"),
        F.when(kind == 2, F.map_from_arrays(pairs["document_id"], pairs["score"])).alias("results"),
    )
    rows.write.json(path)
    return io.read_run(s, path).withColumn("rank", C("rank").cast("long"))


@query("src_csv_wide", "SELECT doc_id::VARCHAR AS doc_id, text, lang FROM documents")
def src_csv_wide(s, d):
    path = scratch(s, "csv")
    io.write_csv(table(s, d, "documents").select("doc_id", "text", "lang"), path)
    return io.read_csv_wide(s, path)


@query("src_idlist", "SELECT DISTINCT doc_id::VARCHAR AS id FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)")
def src_idlist(s, d):
    path = scratch(s, "ids")
    a, b = (table(s, d, t).select(F.concat(F.lit(" "), "doc_id").alias("value")) for t in ("documents", "labels"))
    a.write.text(f"{path}/a")
    b.write.text(f"{path}/b")
    return io.read_idlists(s, f"{path}/*")


@query("src_sweep", "SELECT k::INT AS k, wd::INT AS wd, round(k + wd / 10, 4)::VARCHAR AS first FROM (VALUES (10), (60)) a(k), (VALUES (5), (9)) b(wd)")
def src_sweep(s, d):
    path = scratch(s, "sweep")
    for k in (10, 60):
        for wd in (5, 9):
            s.createDataFrame([("en", "[0.0]"), ("all", f"[{k + wd / 10}, 1.0]")], "collection string, ndcg string").write.option("header", True).option("escape", '"').csv(f"{path}/k{k}_wd{wd}")
    return io.read_sweep(s, f"{path}/*").select("k", "wd", C("ndcg")[0].cast("string").alias("first"))


@query("src_log_parse", "SELECT doc_id, n_chars FROM documents")
def src_log_parse(s, d):
    path = scratch(s, "log")
    table(s, d, "documents").select(F.format_string("INFO step %d done {'doc_id': %d, 'n_chars': %d}", "doc_id", "doc_id", "n_chars").alias("value")).write.text(path)
    return io.read_logged(s, path, "doc_id long, n_chars long")


@query("src_tasks_jsonl", "SELECT conv_id || '::' || turn AS task_id, turn::INT AS turn, text FROM conversations")
def src_tasks_jsonl(s, d):
    from heronlake.sources.schemas import TASKS

    path = scratch(s, "tasks")
    c = table(s, d, "conversations")
    c.select(F.concat("conv_id", F.lit("::"), "turn").alias("task_id"), C("conv_id").cast("string").alias("conversation_id"), C("turn").cast("int").alias("turn"), F.array(F.struct(C("role").alias("speaker"), "text")).alias("input")).write.json(path)
    return io.read_jsonl(s, path, TASKS, strict=True).select("task_id", "turn", C("input")[0]["text"].alias("text"))


@query("snk_atomic", "SELECT doc_id, quality FROM labels")
def snk_atomic(s, d):
    """A second write breaks off; the table of the first is still whole."""
    from pyspark.errors import PySparkException

    path, rows = f"{scratch(s, 'atomic')}/table", table(s, d, "labels").select("doc_id", "quality")
    io.write_atomic(rows.withColumn("quality", C("quality") + 1), path)
    io.write_atomic(rows, path)
    broken = rows.withColumn("quality", F.when(C("doc_id") % 2 == 0, C("quality")).otherwise(F.raise_error(F.lit("torn")).cast("int")))
    try:
        io.write_atomic(broken, path)
    except PySparkException:
        pass
    return s.read.parquet(path)


@query("snk_cache", "SELECT 'again' AS step, vec_id, label FROM embeddings UNION ALL SELECT 'broken', vec_id, label FROM embeddings UNION ALL SELECT 'fewer', vec_id, label FROM embeddings WHERE vec_id % 2 = 0")
def snk_cache(s, d):
    """Made once and asked for again; made anew after its files were spoilt; and another one for other ids under the same key."""
    e = table(s, d, "embeddings").select("vec_id", "label")
    base, spoilt, key = scratch(s, "cache"), scratch(s, "spoilt"), io.cache_key("embeddings", 64, 1.0)
    io.cached(e, base, key)
    again = io.cached(e.limit(0), base, key)
    for f in io.cached(e, spoilt, key, "vec_id").inputFiles():
        io.put_bytes(s, f, b"no table")
    broken = io.cached(e, spoilt, key, "vec_id")
    fewer = io.cached(e.where("vec_id % 2 = 0"), spoilt, key, "vec_id")
    out = None
    for step, x in (("again", again), ("broken", broken), ("fewer", fewer)):
        x = x.withColumn("step", F.lit(step))
        out = x if out is None else out.unionByName(x)
    return out


@query("snk_cache_gc", "SELECT 3::INT AS removed, 2::INT AS left_over")
def snk_cache_gc(s, d):
    base = scratch(s, "gc")
    s.range(5).withColumnRenamed("id", "epoch").withColumn("x", F.lit(1)).write.partitionBy("epoch").parquet(base)
    removed = io.drop_old(s, base, 3)
    return s.read.parquet(base).select("epoch").distinct().agg(F.lit(removed).alias("removed"), F.count(F.lit(1)).cast("int").alias("left_over"))


@query("snk_code_sync", "SELECT 1::INT AS first_time, 0::INT AS again, count(*) AS n FROM labels")
def snk_code_sync(s, d):
    """Files beside a model are copied to where it was tuned, if they aren't there."""
    base = scratch(s, "sync")
    table(s, d, "labels").coalesce(1).write.parquet(f"{base}/a")
    first, again = (io.copy_missing(s, f"{base}/a", f"{base}/b", ".parquet") for _ in range(2))
    return s.read.parquet(f"{base}/b").agg(F.lit(first).alias("first_time"), F.lit(again).alias("again"), F.count(F.lit(1)).alias("n"))


@query("snk_snapshot", "SELECT doc_id, quality FROM labels")
def snk_snapshot(s, d):
    path = scratch(s, "snapshot")
    table(s, d, "labels").select("doc_id", "quality").write.option("sep", "\t").csv(path)
    return s.read.schema("doc_id long, quality int").option("sep", "\t").csv(path)


@query("snk_resume", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.toxic = 1")
def snk_resume(s, d):
    done = table(s, d, "labels").select("doc_id", F.when(C("toxic") == 1, "failed").alias("error"), F.lit(1).alias("at"))
    return inc.pending(table(s, d, "documents").select("doc_id"), done, "doc_id", retry_errors=True)


@query("str_resume_files", "SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations")
def str_resume_files(s, d):
    """A stream over files, in two goes with one checkpoint: the second works on new files only."""
    base, c = scratch(s, "stream"), table(s, d, "conversations")
    for k in (0, 1):
        c.where(C("conv_id") % 2 == k).write.mode("append").json(f"{base}/in")
        inc.process_files(s, f"{base}/in", "conv_id long, turn long, role string, text string", f"{base}/out", f"{base}/checkpoint", lambda df: df.select("conv_id", "turn", F.length("text").cast("long").alias("n")))
    return s.read.parquet(f"{base}/out/*")


@query("ext_tumbling_events", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_tumbling_events(s, d):
    """An extension: hourly counts of events."""
    return inc.tumbling(table(s, d, "events"), "ts", "1 hour", "10 minutes", "event_type")


@query("set_file_diff", "SELECT 'only_b' AS status, 1::BIGINT AS n UNION ALL SELECT 'changed', 1 UNION ALL SELECT 'same', 2")
def set_file_diff(s, d):
    base = scratch(s, "diff")
    for side, files in (("a", {"x": "1", "y": "2", "z": "3"}), ("b", {"x": "1", "y": "9", "z": "3", "w": "4"})):
        for name, text in files.items():
            s.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/{side}/{name}")
    read = lambda side: s.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{base}/{side}").select(F.regexp_extract("path", rf"/{side}/([^/]+)/", 1).alias("name"), F.sha2("content", 256).alias(side))
    j = read("a").join(read("b"), "name", "full_outer")
    status = F.when(C("a").isNull(), "only_b").when(C("b").isNull(), "only_a").when(C("a") == C("b"), "same").otherwise("changed")
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


# providers


@query("met_bertscore")
def met_bertscore(s, d):
    b = table(s, d, "benchmark")
    other = b.select((C("item_id") + 1).alias("item_id"), C("text").alias("target"))
    return b.join(other, "item_id").select("item_id", pv.bert_score(C("text"), C("target")).alias("s")).select("item_id", *[F.round(f"s.{k}", 6).alias(k) for k in ("precision", "recall", "f1")])


@query("met_faith_ragas", "SELECT doc_id, round(quality / 2.0 + 0.25, 6)::DOUBLE AS value FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def met_faith_ragas(s, d):
    """A judge that has run elsewhere: its scores are replayed."""
    stored = table(s, d, "labels").select("doc_id", (C("quality") / 2.0 + 0.25).alias("answer"))
    return pv.replayed(table(s, d, "documents").select("doc_id"), "doc_id", stored).where("answer IS NOT NULL").select("doc_id", F.round("answer", 6).alias("value"))


@query("rr_yesno", "WITH l AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(1 / (1 + exp(ln(exp(e[3]) + exp(e[4])) - ln(exp(e[1]) + exp(e[2])))), 6) AS value FROM l")
def rr_yesno(s, d):
    e = lambda i: C("embedding")[i].cast("double")
    return table(s, d, "embeddings").select("vec_id", F.round(pv.p_yes(F.array(e(0), e(1)), F.array(e(2), e(3))), 6).alias("value"))


def asked(s, d):
    return table(s, d, "benchmark").select("item_id", F.concat(F.lit("Question: "), "text").alias("prompt"))


LEN = "length('Question: ' || text)"


@query("gen_answer", f"SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'stored' WHEN {LEN} % 2 = 0 THEN 'yes' ELSE 'no' END AS answer FROM benchmark")
def gen_answer(s, d):
    """Answers that an earlier run has left blank or not made are made now; the model is a stand-in."""
    before = table(s, d, "benchmark").where("item_id % 3 <= 1").select("item_id", F.when(C("item_id") % 3 == 0, "stored").otherwise("  ").alias("answer"))
    return pv.resumed(asked(s, d), "item_id", "prompt", before, pv.echo).select("item_id", "answer")


@query("judge_llm", f"""WITH p AS (SELECT item_id, length('Rate from 1 to 10.' || chr(10) || 'Question: ' || text) AS r, length('Is it a refusal?' || chr(10) || 'Question: ' || text) AS k FROM benchmark)
SELECT item_id, CASE WHEN r % 4 = 0 THEN 0 ELSE (r % 10 + 1) / 10 END::DOUBLE AS rating, CASE WHEN r % 4 = 0 THEN 'EMPTY_ANSWER' ELSE 'OK' END AS code, CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END AS refusal FROM p""")
def judge_llm(s, d):
    """Two judges, each with prompt, stand-in model and parser: a rating, and whether the answer is a refusal."""
    p = asked(s, d).select("item_id", F.concat(F.lit("Rate from 1 to 10.\n"), "prompt").alias("rate"), F.concat(F.lit("Is it a refusal?\n"), "prompt").alias("refuse"))
    j = pv.answered(pv.answered(p, "rate", pv.graded, "rated"), "refuse", pv.echo, "label")
    return j.select("item_id", jd.rating_or_code(C("rated")).alias("r"), jd.idk_label(C("label")).alias("refusal")).select("item_id", F.round("r.score", 6).alias("rating"), C("r.code").alias("code"), "refusal")


@query("llm_clients", f"SELECT item_id, CASE WHEN {LEN} % 5 = 0 THEN NULL WHEN {LEN} % 2 = 0 THEN 'yes' ELSE 'no' END AS answer FROM benchmark")
def llm_clients(s, d):
    """A client in front of a service that fails now and then, and for some prompts always."""
    return pv.answered(asked(s, d), "prompt", pv.Client(pv.Unsteady())).select("item_id", "answer")


@query("trn_triplet", "SELECT source, arg_max(doc_id, n_chars * 1000000 - doc_id) AS best FROM documents GROUP BY source")
def trn_triplet(s, d):
    """The rule by which a training run keeps its best checkpoint, on documents as epochs."""
    return table(s, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -C("doc_id"))).alias("best"))
