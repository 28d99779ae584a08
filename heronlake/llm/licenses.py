"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are a document's sentences (split after ``.``, ``!`` or ``?`` and white space, but not between two words
between which a template's own wording has such a place, as "v. 2.0" has); a block meets a
template if it contains at least ``THRESHOLD`` of the template's distinct words. The join goes as such joins
do: words are put in one global order, rarest in the corpus first; a template is indexed under its first
|T| - need + 1 words only, one of which any match must contain; a block shorter than ``need``, or whose
remaining words after the shared one can't reach it, is dropped; what is left is verified.
Only words of the templates count for the join, so a document's other words are dropped where it is read,
and texts are read once.

Defined cases: a null text is empty and has no label; first_word and last_word are null without a place;
repeated rows are scanned one by one; an empty table gives an empty result; very long texts are scanned
whole; extra columns don't take part.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import LOWER, UPPER, WS, written

#: Phrases that are looked for word by word. Fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and wording of the templates.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = 0.9

_IN = r"0-9A-Za-z\x80-\x{10FFFF}"
_SEP = rf"[^{_IN}]+"


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(r"[0-9a-z]+", text.lower())))


def need(size: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * size - 1e-9)


def _phrase(words: str) -> str:
    return rf"(?i)(?<![{_IN}])" + _SEP.join(words.split()) + rf"(?![{_IN}])"


def _cuts(templates) -> str:
    """Where blocks end: the white space behind a sentence, but for places that stand in a template's wording."""
    inside = sorted({m.groups() for _, t in templates for m in re.finditer(r"([0-9A-Za-z]+)[^0-9A-Za-z\s]*([.!?])\s+(?=[^0-9A-Za-z]*([0-9A-Za-z]+))", t)})
    words = [rf"(?<=(?<![{_IN}]){a}[^{_IN}\x20\x09-\x0D]{{0,8}}[{end}]){{ws}}[^{_IN}]{{0,8}}{b}(?![{_IN}])" for a, end, b in inside]
    kept = "".join(rf"(?!(?i:{w.replace('{ws}', WS + '+')}))" for w in words)
    return rf"(?<=[.!?]){kept}[\x20\x09-\x0D]+"


def _count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{_IN}]+"))


def scanned(df: DataFrame, id_col: str, text_col: str, templates, threshold: float) -> DataFrame:
    """One pass over the texts: word count, places of the phrases, the template words of the document, and, if
    the document as a whole has enough of them for some template, those of each block."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    d = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("row", F.monotonically_increasing_id())  # stays as written below
    d = d.withColumn("words", F.array_remove(F.split(F.translate("t", UPPER, LOWER), _SEP), ""))
    known = F.array(*[F.lit(w) for w in vocabulary])
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn("hits", F.array_intersect("words", known)).drop("words")
    enough = F.lit(False)
    for _, t in templates:
        ws = template_words(t)
        enough = enough | (F.size(F.array_intersect("hits", F.array(*[F.lit(w) for w in ws]))) >= need(len(ws), threshold))
    blocks = F.split("t", _cuts(templates))
    d = d.withColumn("blocks", F.when(enough, F.transform(blocks, lambda b: F.array_intersect(F.split(F.translate(b, UPPER, LOWER), _SEP), known))))
    some = F.col("t").rlike("|".join(f"(?:{_phrase(p)})" for p, _ in PHRASES))
    parts = [f"p{i}" for i in range(len(PHRASES))]
    d = d.select("*", *[F.when(some, F.split("t", _phrase(p))).alias(c) for c, (p, _) in zip(parts, PHRASES)])
    places, first, last, labels = F.lit(0), [], [], []
    for c, (p, label) in zip(parts, PHRASES):
        n = F.coalesce(F.size(c) - 1, F.lit(0))
        places = places + n
        first.append(F.when(n > 0, _count_words(F.get(c, F.lit(0)))))
        last.append(F.when(n > 0, F.col("n_words") - _count_words(F.element_at(c, -1)) - len(p.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    return d.select(
        "doc_id", "row", "n_words", "hits", "blocks", places.cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"), F.array_sort(F.array_compact(F.array(*labels))).alias("base_labels"),
    )


def matches(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """row, block, template, containment: all pairs at or over the threshold."""
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    # document frequencies of the templates' words: never more rows than the templates have words
    counts = {r[0]: r[1] for r in docs.select(F.explode("hits").alias("w")).groupBy("w").count().collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for k, (_, t) in enumerate(templates):
        ranks = sorted(rank[w] for w in template_words(t))
        least = need(len(ranks), threshold)
        index += [(ranks[i], k, i, ranks, least) for i in range(len(ranks) - least + 1)]
    index = F.broadcast(spark.createDataFrame(index, "r int, template int, at int, ranks array<int>, least int"))
    to_rank = F.create_map(*[F.lit(x) for w, i in rank.items() for x in (w, i)])
    b = docs.where(F.col("blocks").isNotNull()).select("row", F.posexplode("blocks").alias("block", "ws"))
    b = b.where(F.size("ws") > 0).withColumn("b", F.array_sort(F.transform("ws", lambda w: F.element_at(to_rank, w))))
    b = b.select("row", "block", "b", F.posexplode("b").alias("q", "r"))
    c = b.join(index, "r").where((F.size("b") >= F.col("least")) & (1 + F.least(F.size("ranks") - F.col("at"), F.size("b") - F.col("q")) - 1 >= F.col("least")))
    shared = F.size(F.array_intersect("b", "ranks"))
    return c.where(shared >= F.col("least")).select("row", "block", "template", (shared / F.size("ranks")).alias("containment")).distinct()


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays),
    score: 1 where a phrase stands, else the largest containment that reached the threshold, else 0."""
    docs = written(scanned(df, id_col, text_col, templates, threshold), "license-docs")
    names = F.array(*[F.lit(label) for label, _ in templates])
    found = matches(docs, templates, threshold).groupBy("row").agg(
        F.collect_set(F.get(names, F.col("template"))).alias("more"), F.max("containment").alias("best")
    )
    d = docs.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").join(found, "row", "left")
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
