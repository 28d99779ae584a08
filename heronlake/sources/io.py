"""Readers and writers of the formats that retrieval data comes in."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.sources.schemas import QRELS
from heronlake.sources.scratch import scratch


def read_jsonl(spark: SparkSession, path: str, schema, strict: bool = False) -> DataFrame:
    """Records with an explicit schema; gzip by extension; a broken line is null, or an error if ``strict``."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str, compression: str = "none", partition_by: str | None = None) -> None:
    w = df.write.option("compression", compression)
    (w.partitionBy(partition_by) if partition_by else w).json(path)


def jsonl_round_trip(df: DataFrame, name: str, compression: str = "none") -> DataFrame:
    path = scratch(df.sparkSession, name)
    write_jsonl(df, path, compression)
    return read_jsonl(df.sparkSession, path, df.schema, strict=True)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """With a header. Cells may hold separators, quotes and line ends, and keep blanks at their ends; nulls are bare, empty texts
    quoted."""
    own = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.options(header=True, sep=sep, escape='"', **own).csv(path)


def _csv_reader(spark: SparkSession, sep: str = ","):
    """Reads what ``write_csv`` writes: a bare empty cell is null, a quoted one is an empty text."""
    import uuid

    # Spark takes cells that equal nullValue, by default the empty text, for null even if they are quoted
    return spark.read.options(header=True, sep=sep, multiLine=True, escape='"', maxCharsPerColumn=-1, nullValue=uuid.uuid4().hex, emptyValue="")


def csv_round_trip(df: DataFrame, name: str, sep: str = ",") -> DataFrame:
    """Cells may hold separators, quotes and line ends."""
    path = scratch(df.sparkSession, name)
    write_csv(df, path, sep)
    return _csv_reader(df.sparkSession, sep).schema(df.schema).csv(path)


def read_csv_wide(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings, of any size, without a byte-order mark in the first name."""
    d = _csv_reader(spark).csv(path)
    return d.toDF(*[c.lstrip("﻿") for c in d.columns])


def read_zip(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """JSON lines of a member of zip files, an archive to a task."""
    import zipfile
    from io import BytesIO

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(BytesIO(content)) as z, z.open(member) as f:
                    lines = [x.decode() for x in f if x.strip()]
                yield pd.DataFrame({"line": lines})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "line string")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def write_zips(df: DataFrame, path: str, member: str, name: str = "name", lines: str = "lines") -> None:
    """A zip archive for each row: its ``lines`` (array of strings) as the one member. Executors pack, and the driver, which
    holds one archive at a time, puts them where the session's file system says."""
    import zipfile
    from io import BytesIO

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for n, rows in zip(pdf["name"], pdf["lines"]):
                b = BytesIO()
                with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(member, "\n".join(rows))
                yield pd.DataFrame({"name": [n], "content": [b.getvalue()]})

    spark = df.sparkSession
    for row in df.select(F.col(name).cast("string").alias("name"), F.col(lines).alias("lines")).mapInPandas(run, "name string, content binary").toLocalIterator():
        put_bytes(spark, f"{path}/{row.name}.zip", bytes(row.content))


def put_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(content)
    finally:
        out.close()


def write_beir(queries: DataFrame, qrels: DataFrame, base: str) -> None:
    """A folder for each collection: queries (collection, _id, text) as JSON lines, qrels (collection, query-id, corpus-id,
    score) as a table with a header."""
    queries.select("collection", "_id", "text").write.partitionBy("collection").json(f"{base}/queries")
    qrels.select("collection", "query-id", "corpus-id", "score").write.partitionBy("collection").option("header", True).option("sep", "\t").csv(f"{base}/qrels")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, rel of a table with a header; of repeated pairs the last counts, by file and place."""
    d = spark.read.schema(QRELS).option("sep", "\t").option("header", True).csv(path)
    d = d.withColumn("at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return d.groupBy(F.col("query-id").alias("qid"), F.col("corpus-id").alias("doc_id")).agg(F.max_by("score", "at").alias("rel"))


def read_qrels_any(spark: SparkSession, path: str, rel_min: int = 1, whole: bool = False) -> DataFrame:
    """qid, doc_id, rel from lines of three columns (with or without a header), four columns whose second is 0, JSON objects,
    JSON lists of objects, or JSON objects of queries that hold objects of documents. With ``whole``, a file that begins
    with a bracket is one JSON value on many lines; other files are taken by lines all the same."""
    text = spark.read.text(path, wholetext=whole)
    if whole:
        text = text.select(F.explode(F.when(F.ltrim("value").rlike(r"^\s*[\[{]\s*[\n\r]"), F.array("value")).otherwise(F.split("value", r"\r?\n"))).alias("value"))
    line = text.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("value")).where("value <> ''")
    p = F.split("value", r"\s+")
    fields = "`query-id` string, `corpus-id` string, qid string, doc_id string, score int, rel int"
    own = lambda j: F.struct(F.coalesce(j["query-id"], j["qid"]).alias("qid"), F.coalesce(j["corpus-id"], j["doc_id"]).alias("doc_id"), F.coalesce(j["score"], j["rel"]).alias("rel"))
    plain = F.when(F.size(p) >= 4, F.struct(p[0].alias("qid"), p[2].alias("doc_id"), p[3].try_cast("int").alias("rel"))).otherwise(
        F.struct(F.get(p, F.lit(0)).alias("qid"), F.get(p, F.lit(1)).alias("doc_id"), F.get(p, F.lit(2)).try_cast("int").alias("rel"))
    )
    listed = F.transform(F.from_json("value", f"array<struct<{fields.replace(' string', ': string').replace(' int', ': int')}>>"), own)
    nested = F.from_json("value", "map<string, map<string, int>>")
    mapped = F.flatten(F.transform(F.map_entries(nested), lambda q: F.transform(F.map_entries(q["value"]), lambda x: F.struct(q["key"].alias("qid"), x["key"].alias("doc_id"), x["value"].alias("rel")))))
    one = own(F.from_json("value", fields))
    rows = F.when(F.col("value").startswith("["), listed).when(F.col("value").startswith("{"), F.when(one["qid"].isNotNull(), F.array(one)).otherwise(mapped)).otherwise(F.array(plain))
    d = line.select(F.explode(rows).alias("r")).select("r.*")
    return d.where(F.col("rel") >= rel_min)  # a header has no number


def read_idlists(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of text files, one to a line."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """qid, doc_id, score, rank of runs in any of three layouts: contexts, documents, or a map of results."""
    from heronlake.sources.schemas import RUNS, first_present

    d = spark.read.schema(RUNS).json(path)
    from_map = F.transform(F.map_entries("results"), lambda e: F.struct(e["key"].alias("document_id"), e["value"].alias("score")))
    from_map = F.array_sort(from_map, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0))
    d = d.select(first_present(F.col("task_id"), F.col("_id"), F.col("query_id")).alias("qid"), F.posexplode(F.coalesce("contexts", "documents", from_map)).alias("pos", "c"))
    return d.select("qid", F.col("c.document_id").alias("doc_id"), F.col("c.score").alias("score"), (F.col("pos") + 1).alias("rank"))


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """k, wd and the list cells of result tables, whose parameters stand in the file's folder name (k=..,wd=..)."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    name = F.col("_metadata.file_path")
    d = d.where("collection = 'all'").select(F.regexp_extract(name, r"k(\d+)_", 1).cast("int").alias("k"), F.regexp_extract(name, r"_wd(\d+)", 1).cast("int").alias("wd"), F.from_json("ndcg", "array<double>").alias("ndcg"))
    return d


def read_logged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Dictionary literals that a log's lines end with."""
    d = spark.read.text(path).select(F.regexp_extract("value", r"(\{.*\})\s*$", 1).alias("x")).where("x <> ''")
    return d.select(F.from_json("x", schema, {"allowSingleQuotes": "true"}).alias("r")).select("r.*")


def cache_key(*parts) -> str:
    import hashlib

    return hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()


def cached(df: DataFrame, base: str, key: str, id_col: str | None = None) -> DataFrame:
    """The table under ``base/cache_key=key``, made from ``df`` if it isn't there; Spark's committer makes it appear whole. With
    ``id_col`` it is of the same ids, or it is stale and another one is made beside it. One whose files can't be opened is
    made again."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    spark = df.sparkSession
    path = f"{base}/cache_key={key}"
    if id_col is not None:
        h = F.xxhash64(id_col)
        n, x, total = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
        path += f"/ids={cache_key(n, x, total)}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        try:
            found = spark.read.schema(df.schema).parquet(path)
            found.count()  # opens every file, reads no column
            return found
        except (PySparkException, Py4JJavaError):  # a file that is no table fails in the JVM
            pass
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_atomic(df: DataFrame, path: str) -> None:
    """Replaces the table at ``path`` once the new one is written whole; a write that fails leaves the old one as it was."""
    import uuid

    spark = df.sparkSession
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.{uuid.uuid4().hex}.part", path))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{new.toString()} can't be renamed")


def drop_old(spark: SparkSession, base: str, keep_from: int) -> int:
    """Removes the folders ``epoch=N`` with N under ``keep_from``; the number removed."""
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs, n = root.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("epoch=") and int(name[6:]) < keep_from:
            fs.delete(status.getPath(), True)
            n += 1
    return n


def copy_missing(spark: SparkSession, source: str, target: str, suffix: str) -> int:
    """Copies files of ``source`` whose names end in ``suffix`` and that ``target`` lacks; the number copied."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fa, fb, n = a.getFileSystem(conf), b.getFileSystem(conf), 0
    fb.mkdirs(b)
    for status in fa.listStatus(a):
        name = status.getPath().getName()
        to = jvm.org.apache.hadoop.fs.Path(b, name)
        if name.endswith(suffix) and not fb.exists(to):
            n += bool(jvm.org.apache.hadoop.fs.FileUtil.copy(fa, status.getPath(), fb, to, False, conf))
    return n
