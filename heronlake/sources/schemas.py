"""Explicit schemas and the coalescing rules by which ids and texts are found in records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PASSAGES = "_id string, id string, document_id string, title string, text string, contents string, content string, url string, source string"
QUERIES = "_id string, task_id string, query_id string, id string, text string, Collection string"
QRELS = "`query-id` string, `corpus-id` string, score int"
TASKS = (
    "task_id string, conversation_id string, task_type string, turn int, Collection string, dataset string, "
    "contexts array<struct<document_id: string, text: string, title: string, score: double>>, input array<struct<speaker: string, text: string>>, "
    "targets array<struct<speaker: string, text: string>>, predictions array<struct<text: string>>, answerability array<string>, metrics map<string, array<double>>"
)
RUNS = (
    "task_id string, _id string, query_id string, Collection string, contexts array<struct<document_id: string, score: double>>, "
    "documents array<struct<document_id: string, score: double>>, results map<string, double>"
)

#: Textual nulls.
NULLS = ("", "nan", "none", "null")


def to_null(c: Column) -> Column:
    """NULL for blank cells and for words that mean none."""
    return F.when(~F.lower(F.trim(c)).isin(*NULLS), c)


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in columns])


def resolve_id(df, order=("document_id", "_id", "id")) -> Column:
    return first_present(*[F.col(c) for c in order if c in df.columns])


def resolve_text(df, order=("ctx_text", "text", "query", "contents", "content", "document", "passage", "body")) -> Column:
    """The first non-blank one."""
    return F.coalesce(*[F.when(F.length(F.trim(F.col(c))) > 0, F.col(c)) for c in order if c in df.columns])
