"""Checks of prediction files and of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Required fields of a prediction file and their kinds, by mode. Fixed values.
FIELDS = {
    "retrieval_taska": {"task_id": "string", "Collection": "string", "contexts": "list"},
    "generation_taskb": {"task_id": "string", "input": "list", "contexts": "list", "predictions": "list"},
    "rag_taskc": {"task_id": "string", "Collection": "string", "input": "list", "contexts": "list", "predictions": "list"},
}
#: A task may have so many contexts. Fixed value.
MAX_CONTEXTS = 10
_KINDS = {"string": "^STRING", "list": "^ARRAY", "number": "^(BIGINT|INT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)", "object": "^OBJECT"}


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).rlike(_KINDS[kind])


def _members(v: Column, name: str, wanted: dict[str, str]) -> Column:
    """Problems of the objects of a list: no object, a field that is missing or of another kind."""

    def of(x: Column, i: Column) -> Column:
        place = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
        checks = [
            F.when(_at(x, f).isNull(), F.concat(place, F.lit(f" missing {f}"))).when(~_is(_at(x, f), kind), F.concat(place, F.lit(f".{f} is no {kind}")))
            for f, kind in wanted.items()
        ]
        return F.when(_is(x, "object"), F.array_compact(F.array(*checks))).otherwise(F.array(F.concat(place, F.lit(" is no object"))))

    items = F.try_variant_get(v, f"$.{name}", "array<variant>")
    return F.coalesce(F.flatten(F.transform(items, of)), F.array().cast("array<string>"))


def prediction_problems(lines: DataFrame, line: str, number: str, mode: str) -> DataFrame:
    """number, level, problem: what is wrong with each line of a prediction file. Blank lines are passed over; no contexts are
    a warning."""
    v = F.col("__v")
    d = lines.where(F.trim(line) != "").select(number, F.try_parse_json(line).alias("__v"))
    fields = [F.when(_at(v, f).isNull(), f"missing {f}").when(~_is(_at(v, f), kind), f"{f} is no {kind}") for f, kind in FIELDS[mode].items()]
    n = F.size(F.try_variant_get(v, "$.contexts", "array<variant>"))
    errors = F.concat(F.array_compact(F.array(*fields, F.when(n > MAX_CONTEXTS, "too many contexts"))), _members(v, "contexts", {"document_id": "string", "score": "number"}))
    if "predictions" in FIELDS[mode]:
        errors = F.concat(errors, _members(v, "predictions", {"text": "string"}))
    tagged = lambda a, level: F.transform(a, lambda p: F.struct(F.lit(level).alias("level"), p.alias("problem")))
    warnings = F.array_compact(F.array(F.when(n == 0, "empty contexts")))
    found = F.when(v.isNull(), tagged(F.array(F.lit("not JSON")), "error")).otherwise(F.concat(tagged(errors, "error"), tagged(warnings, "warning")))
    return d.select(number, F.explode(found).alias("f")).select(number, "f.*")


def chunk_problems(chunks: DataFrame, parents: DataFrame, places: DataFrame, n_tokens: Column, most: int, spare: int = 0, mark: str = "__c") -> DataFrame:
    """chunk_id, problem. ``chunks`` have chunk_id, parent_id, start, end, text; ``parents`` have parent_id, whole; ``places``
    (chunk_id, m_parent, m_start, m_end) say again where chunks stand. A missing parent or bad offsets end a chunk's checks."""
    j = chunks.join(parents, "parent_id", "left").join(places.withColumn("__m", F.lit(True)), "chunk_id", "left")
    c = F.col
    lost = c("whole").isNull()
    name = F.when(~c("chunk_id").startswith(F.concat(c("parent_id"), F.lit(mark))), "bad id")
    off = F.coalesce((c("start") < 0) | (c("end") <= c("start")) | (c("end") > F.length("whole")), F.lit(True))
    later = [
        F.when(F.substr("whole", (c("start") + 1).cast("int"), (c("end") - c("start")).cast("int")) != c("text"), "other text"),
        F.when(n_tokens > most + spare, "too long"),
        F.when(c("__m").isNull(), "not in map").when(~(c("m_parent").eqNullSafe(c("parent_id")) & c("m_start").eqNullSafe(c("start")) & c("m_end").eqNullSafe(c("end"))), "other place in map"),
    ]
    found = F.when(lost, F.array(F.lit("no parent"))).when(off, F.array_compact(F.array(name, F.lit("bad offsets")))).otherwise(F.array_compact(F.array(name, *later)))
    return j.select("chunk_id", F.explode(found).alias("problem"))


def counted(problems: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """problem, n, examples: each kind with its number and the least few keys."""
    some = problems.withColumn("__r", F.row_number().over(Window.partitionBy("problem").orderBy(key))).where(F.col("__r") <= examples)
    some = some.groupBy("problem").agg(F.array_join(F.sort_array(F.collect_list(key)), ",").alias("examples"))
    return problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).join(some, "problem")
