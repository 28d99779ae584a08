"""Rule-based document quality: a threshold table compiled into Spark projections.

Everything is a DataFrame expression. Each document is judged from its own row, so the plan has no
exchange, and a long document costs time in proportion to its words (times a logarithm where
windows repeat).

Defined cases: a null text counts as empty; an empty text has zeros everywhere and fails the base
rule; repeated rows are judged one by one; a null id is kept as it is; extra columns of the input,
whatever their names, don't take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import BLANKS, WS, fresh, text_or_empty

WINDOW = 8

#: Frequent function words of English, French, German and Spanish, in lower case.
STOP_WORDS = (
    "the of and to in a is that it for was with as on be by this are or from at an "
    "de la le les et des un une du en que qui est pour dans sur par au pas "
    "der die und das den von zu mit ein ist im für auf sich nicht dem "
    "el y los se del las por con una su para como al lo no es"
).split()

#: name, ratio as SQL over the features, least, most. A document must lie within every row's bounds.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_chars", "word_chars / n_words", 2.0, 15.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.1),
    ("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    ("dup_line_ratio", "n_dup_lines / n_lines", None, 0.5),
    ("capital_ratio", "n_capitals / word_chars", None, 0.4),
    ("exclaimed_ratio", "n_exclaimed / n_words", None, 0.2),
)


def add_features(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with working columns, and the features as columns over it, by name."""
    t, words, wins, pairs, lines, idx = fresh(df, "t", "words", "wins", "pairs", "lines", "idx")
    keep = df.columns
    d = df.select(*[df[c] for c in keep], text_or_empty(text_col).alias(t))
    trimmed = F.btrim(F.col(t), F.lit(BLANKS))
    d = d.withColumn(words, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS + "+")))
    d = d.withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size(words)
    # Equal windows always have equal hashes: texts without an equal pair of hashes have no repeat. A
    # window's hash is made by doubling, from words to pairs, fours and eights; each pass looks at an
    # element once.
    d = d.withColumn(wins, F.expr(f"CASE WHEN size(`{words}`) > {WINDOW} THEN transform(`{words}`, w -> xxhash64(w)) END"))
    for step in (1, 2, 4):
        d = d.withColumn(wins, F.expr(f"zip_with(`{wins}`, slice(`{wins}`, {step + 1}, size(`{wins}`)), (a, b) -> xxhash64(a, b))"))
    d = d.withColumn(wins, F.expr(f"slice(`{wins}`, 1, size(`{wins}`) - {WINDOW - 1})"))
    repeated = F.size(F.array_distinct(wins)) < F.size(wins)
    # in the others, windows are compared by their words; words hold no blank, so joining is one to one
    d = d.withColumn(
        pairs,
        F.when(
            repeated,
            F.array_sort(
                F.expr(
                    f"transform(sequence(1, size(`{words}`) - {WINDOW - 1}),"
                    f" i -> named_struct('w', array_join(slice(`{words}`, i, {WINDOW}), ' '), 'i', i))"
                )
            ),
        ),
    )
    d = d.withColumn(
        idx,
        F.expr(
            f"array_sort(transform(filter(sequence(0, size(`{pairs}`) - 1), j -> get(`{pairs}`, j).w <=> get(`{pairs}`, j - 1).w"
            f" OR get(`{pairs}`, j).w <=> get(`{pairs}`, j + 1).w), j -> get(`{pairs}`, j).i))"
        ),
    )
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    features = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(
            F.expr(
                f"aggregate(`{idx}`, named_struct('n', 0L, 'last', -{WINDOW}), (a, i) ->"
                f" named_struct('n', a.n + least({WINDOW}, i - a.last), 'last', i), a -> a.n)"
            ),
            F.lit(0),
        ).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_stop_words": F.expr(f"size(filter(`{words}`, w -> w IN ({stops})))").cast("long"),
        "n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
        "n_exclaimed": F.regexp_count(t, F.lit(r"!(?=[\x20\x09-\x0D]|$)")).cast("long"),
    }
    return d, features


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHERS = ("n_lines", "n_stop_words", "n_capitals", "n_exclaimed")


def base_failed(f: dict[str, Column]) -> Column:
    return (f["n_words"] < 20) | (F.lit(100) * f["n_repeat_words"] > F.lit(30) * f["n_words"])


def compiled(f: dict[str, Column], rules=RULES) -> list[tuple[str, Column]]:
    """A verdict column for each row of the threshold table; a ratio over nothing passes."""
    out = []
    for name, ratio, least, most in rules:
        top, bottom = (f[x.strip()] for x in ratio.split("/"))
        r = F.when(bottom > 0, top.cast("double") / bottom)
        ok = F.lit(True)
        if least is not None:
            ok = ok & F.coalesce(r >= least, F.lit(True))
        if most is not None:
            ok = ok & F.coalesce(r <= most, F.lit(True))
        out.append((name, ok))
    return out


def judged(df: DataFrame, text_col: str = "text", rules=RULES) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with one struct column per feature set and verdict; the names of the added columns."""
    d, feats = add_features(df, text_col)
    names = dict(zip((*FEATURES, *OTHERS, "base_failed", "failed_rules", "kept"), fresh(df, *FEATURES, *OTHERS, "base_failed", "failed_rules", "kept")))
    d = d.select(*[d[c] for c in df.columns], *[feats[k].alias(names[k]) for k in (*FEATURES, *OTHERS)])
    f = {k: F.col(names[k]) for k in (*FEATURES, *OTHERS)}
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in compiled(f, rules)]))
    d = d.withColumn(names["base_failed"], base_failed(f)).withColumn(names["failed_rules"], failed)
    d = d.withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.size(names["failed_rules"]) == 0))
    return d, names


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Features and verdicts of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and
    failed_rules (names of the rows of the threshold table that the document breaks).
    """
    d, names = judged(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rules)
    return d.select("doc_id", *[F.col(names[k]).alias(k) for k in (*FEATURES, "base_failed", "kept", "failed_rules")])


def filter_quality(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``df`` that pass, with the columns of ``df``.

    The optimizer moves filters below projections by copying what they refer to, which would copy the chain of features
    many times over; a row number beside the verdict, of which the filter makes use too, keeps the filter in its place.
    """
    d, names = judged(df, text_col, rules)
    (mark,) = fresh(d, "mark")
    d = d.withColumn(mark, F.monotonically_increasing_id())
    return d.where(F.col(names["kept"]) & (F.col(mark) >= 0)).select(*[d[c] for c in df.columns])
