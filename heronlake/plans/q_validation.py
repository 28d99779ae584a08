"""Queries of the validators. Lines and chunks are made from the tables, some of them faulty, by expressions that Spark and
DuckDB share; what is wrong with them each finds by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import corpus as cp
from heronlake.operators import validation as vl
from heronlake.plans.registry import query
from heronlake.sources.scratch import table

_HEAD = """'{"task_id": "' || conv_id || '", "Collection": "c", "input": [], '"""
_CTX = """'{"document_id": "d' || turn || '", "score": ' || turn || '.5}'"""
LINE = f"""CASE (conv_id + turn) % 9
 WHEN 1 THEN '{{"task_id": '
 WHEN 2 THEN '{{"task_id": 5, "Collection": null, "input": {{}}, "contexts": [' || {_CTX} || '], "predictions": [{{"text": "a"}}]}}'
 WHEN 3 THEN {_HEAD} || '"predictions": "none"}}'
 WHEN 4 THEN {_HEAD} || '"contexts": [' || repeat({_CTX} || ', ', 10) || {_CTX} || '], "predictions": []}}'
 WHEN 5 THEN {_HEAD} || '"contexts": [' || {_CTX} || ', {{"document_id": 7}}, "x"], "predictions": [{{"text": "a"}}]}}'
 WHEN 6 THEN {_HEAD} || '"contexts": [' || {_CTX} || '], "predictions": [3, {{"x": 1}}, {{"text": []}}]}}'
 WHEN 7 THEN '{{"task_id": "t", "input": [], "contexts": [], "predictions": []}}'
 WHEN 8 THEN '  '
 ELSE {_HEAD} || '"contexts": [' || {_CTX} || '], "predictions": [{{"text": "a"}}]}}' END"""
_KINDS = {"task_id": ("VARCHAR", "string"), "Collection": ("VARCHAR", "string"), "input": ("ARRAY", "list"), "contexts": ("ARRAY", "list"), "predictions": ("ARRAY", "list")}


def _members_sql(name: str, fields) -> str:
    src = f"(SELECT line_no, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS i FROM (SELECT line_no, json_extract(j, '$.{name}[*]') AS a FROM j WHERE j IS NOT NULL))"
    out = f" UNION ALL SELECT line_no, 'error', '{name}[' || i || '] is no object' FROM {src} WHERE json_type(x) <> 'OBJECT'"
    for f, kinds, kind in fields:
        out += f" UNION ALL SELECT line_no, 'error', '{name}[' || i || '] missing {f}' FROM {src} WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.{f}') IS NULL"
        out += f" UNION ALL SELECT line_no, 'error', '{name}[' || i || '].{f} is no {kind}' FROM {src} WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.{f}') NOT IN ({kinds})"
    return out


VAL = f"WITH j AS (SELECT conv_id * 1000 + turn AS line_no, json_valid(line) AS ok, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM (SELECT conv_id, turn, {LINE} AS line FROM conversations) WHERE trim(line) <> '') SELECT line_no, 'error' AS level, 'not JSON' AS problem FROM j WHERE NOT ok"
for _f, (_t, _kind) in _KINDS.items():
    VAL += f" UNION ALL SELECT line_no, 'error', CASE WHEN json_type(j, '$.{_f}') IS NULL THEN 'missing {_f}' ELSE '{_f} is no {_kind}' END FROM j WHERE ok AND json_type(j, '$.{_f}') IS DISTINCT FROM '{_t}'"
VAL += " UNION ALL SELECT line_no, 'error', 'too many contexts' FROM j WHERE json_array_length(j, '$.contexts') > 10 UNION ALL SELECT line_no, 'warning', 'empty contexts' FROM j WHERE json_type(j, '$.contexts') = 'ARRAY' AND json_array_length(j, '$.contexts') = 0"
VAL += _members_sql("contexts", [("document_id", "'VARCHAR'", "string"), ("score", "'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN'", "number")]) + _members_sql("predictions", [("text", "'VARCHAR'", "string")])


@query("val_format", VAL)
def val_format(s, d):
    """A row for each fault of a prediction file with retrieved contexts and answers."""
    lines = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.expr(LINE).alias("line"))
    return vl.prediction_problems(lines, "line", "line_no", "rag_taskc")


CHUNK = """SELECT CASE (doc_id + i) % 8 WHEN 1 THEN doc_id || '_c' || i ELSE doc_id || '__c' || i END AS chunk_id, CAST(CASE (doc_id + i) % 8 WHEN 2 THEN doc_id + 1000000000 ELSE doc_id END AS VARCHAR(20)) AS parent_id,
 i * 100 AS start, CASE (doc_id + i) % 8 WHEN 3 THEN i * 100 ELSE i * 100 + 150 END AS finish, substring(text, CAST(i * 100 + 1 AS INT), 150) || CASE (doc_id + i) % 8 WHEN 4 THEN '+' ELSE '' END AS text, (doc_id + i) % 8 AS k FROM documents d CROSS JOIN (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT)), (CAST(2 AS BIGINT))) x(i)"""
CHECK = f"""WITH c AS ({CHUNK}), p AS (SELECT doc_id::VARCHAR AS parent_id, text AS whole FROM documents), m AS (SELECT chunk_id, parent_id AS mp, start + CASE k WHEN 6 THEN 1 ELSE 0 END AS ms, finish AS me FROM c WHERE k <> 5),
j AS (SELECT c.*, whole, mp, ms, me, whole IS NULL AS lost, start < 0 OR finish <= start OR finish > length(whole) AS off FROM c LEFT JOIN p USING (parent_id) LEFT JOIN m USING (chunk_id)),
e AS (SELECT chunk_id, unnest(CASE WHEN lost THEN ['no parent'] ELSE list_filter([CASE WHEN NOT starts_with(chunk_id, parent_id || '__c') THEN 'bad id' END, CASE WHEN off THEN 'bad offsets' END,
 CASE WHEN NOT off AND substring(whole, start + 1, finish - start) <> text THEN 'other text' END, CASE WHEN NOT off AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 26 THEN 'too long' END,
 CASE WHEN NOT off AND mp IS NULL THEN 'not in map' WHEN NOT off AND (mp <> parent_id OR ms <> start OR me <> finish) THEN 'other place in map' END], lambda x: x IS NOT NULL) END) AS problem FROM j)
SELECT problem, count(*) AS n, array_to_string(list_sort(list(chunk_id))[1:5], ',') AS examples FROM e GROUP BY problem"""


@query("val_chunks", CHECK)
def val_chunks(s, d):
    """Kinds of faults of chunks with their numbers and five examples."""
    docs = table(s, d, "documents").select("doc_id", "text")
    i = F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)]))
    k = (F.col("doc_id") + F.col("i")) % 8
    text = F.concat(F.substr("text", (F.col("i") * 100 + 1).cast("int"), F.lit(150)), F.when(k == 4, "+").otherwise(""))
    c = docs.withColumn("i", i).select(
        F.concat("doc_id", F.when(k == 1, "_c").otherwise("__c"), "i").alias("chunk_id"), F.when(k == 2, F.col("doc_id") + 1000000000).otherwise(F.col("doc_id")).cast("string").alias("parent_id"),
        (F.col("i") * 100).alias("start"), (F.col("i") * 100 + F.when(k == 3, 0).otherwise(150)).alias("end"), text.alias("text"), k.alias("k"),
    )
    places = c.where("k <> 5").select("chunk_id", F.col("parent_id").alias("m_parent"), (F.col("start") + F.when(F.col("k") == 6, 1).otherwise(0)).alias("m_start"), F.col("end").alias("m_end"))
    parents = docs.select(F.col("doc_id").cast("string").alias("parent_id"), F.col("text").alias("whole"))
    return vl.counted(vl.chunk_problems(c.drop("k"), parents, places, F.size(cp.words(F.col("text"))), 24, 2), "chunk_id")
