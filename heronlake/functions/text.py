"""Text functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation. Fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Stop words for keywords.
STOPWORDS = (
    "a an the and or but if then else of to in on at by for with from as is are was were be been being this that these those it its "
    "i you he she we they them his her our your their not no do does did have has had will would can could should may might must "
    "what which who whom when where why how about into over under than so such also there here"
).split()

#: Words that refer back, and so need a history. Fixed values.
PRONOUNS = ("it", "they", "this", "that", "these", "those", "he", "she", "them", "him", "her", "back then")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_qa(c: Column) -> Column:
    """Lower case, without ASCII punctuation, then without articles, with single blanks. Punctuation goes first: ``a.`` is an article."""
    c = F.translate(F.lower(c), PUNCTUATION, "")
    return squeeze(F.regexp_replace(c, r"\b(a|an|the)\b", " "))


#: What a line of page furniture holds, whatever the case. Fixed values.
BOILERPLATE = (
    r"Saving your location allows us to provide you with more relevant information",
    r"\bSet Location\b",
    r"Office of the Patient Advocate - State of California",
    r"^\s*[×x]\s*$",
)


def norm_dedup(c: Column, boilerplate=BOILERPLATE) -> Column:
    """Without boilerplate lines, with single blanks."""
    rule = "(?i)" + "|".join(f"(?:{p})" for p in boilerplate)
    return squeeze(F.array_join(F.filter(F.split(c, r"\r\n|\n|\r"), lambda x: ~F.trim(x).rlike(rule)), " "))


def norm_query(c: Column) -> Column:
    """Lower case, single blanks, letters, digits, ``_``, ``'`` and ``-`` only."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s'-]", ""))


def strip_newline(c: Column) -> Column:
    """Line ends as blanks, no signs, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "\n", " "), r"[^\p{L}\p{N}_\s]", ""))


def strip_user(c: Column) -> Column:
    """Lines without a leading |user|: mark."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\|user\|:\s*", ""))), "\n")


def sentences(c: Column) -> Column:
    """Paragraphs (blank lines between), cut after ``.``, ``!`` or ``?`` and white space."""
    parts = F.flatten(F.transform(F.split(c, r"\n\n"), lambda p: F.split(p, r"(?<=[.!?])\s+")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def context_sentences(c: Column, most: int = 30) -> Column:
    """Cut after ``.``, ``!`` or ``?`` and white space, and at line ends; the first ``most``."""
    parts = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(parts, 1, most)


def ascii_ratio(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 0, F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / n).otherwise(F.lit(0.0))


def language(c: Column) -> Column:
    """unk, en_like, ru_like, zh_like or non_en_like, and a score, by the shares of scripts."""
    r = ascii_ratio(c)
    blank = F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")) == ""
    lang = (
        F.when(blank, "unk").when(r > 0.9, "en_like").when(c.rlike(r"[\x{0400}-\x{04FF}]"), "ru_like").when(c.rlike(r"[\x{4E00}-\x{9FFF}]"), "zh_like").otherwise("non_en_like")
    )
    score = F.when(blank, 0.0).when(r > 0.9, r).when(c.rlike(r"[\x{0400}-\x{04FF}]") | c.rlike(r"[\x{4E00}-\x{9FFF}]"), 1.0).otherwise(1 - r)
    return F.struct(lang.alias("lang"), score.alias("score"))


def non_english_line(c: Column) -> Column:
    """Mostly of another script: three CJK or Cyrillic letters, or two fifths of non-ASCII signs, and hardly a Latin letter."""
    other = F.length(F.regexp_replace(c, r"[^\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{0400}-\x{04FF}]", ""))
    latin = F.length(F.regexp_replace(c, r"[^A-Za-z]", ""))
    n = F.length(c)
    foreign = F.when(n > 0, F.length(F.regexp_replace(c, r"[\x00-\x7F]", "")) / n).otherwise(F.lit(0.0))
    return ((other >= 3) & (latin < 3)) | ((foreign >= 0.40) & (latin < 3))


def nfkc(c: Column) -> Column:
    """NFKC form; Spark has no such function, so this one runs in Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return run(c)


def clean_mixed(c: Column) -> Column:
    """Without control signs, encoded blobs, lines of other scripts and needless blanks; wants NFKC text."""
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), r"[\x00-\x08\x0B-\x1F]", "")
    c = F.regexp_replace(c, r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{120,}={0,2}(?![A-Za-z0-9+/=])", " ")
    c = F.regexp_replace(c, r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])", " ")
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.rtrim(x)), lambda x: ~non_english_line(x))
    c = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def clean_html(c: Column) -> Column:
    """Entities decoded, tags away; the standard library's decoder, in Arrow batches."""
    import html
    import re


    tag = re.compile(r"<[^>]*>")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else tag.sub("", html.unescape(x)))

    return run(c)


def spans(c: Column) -> Column:
    """Trimmed sentence spans [start, end) with their offsets in code points."""
    import re


    cut = re.compile(r"(?<=[.!?])\s+|\n{2,}")

    def one(text: str | None) -> list[dict]:
        out, at = [], 0
        for m in [*cut.finditer(text or ""), None]:
            end = m.start() if m else len(text or "")
            piece = (text or "")[at:end]
            start = at + len(piece) - len(piece.lstrip())
            stop = at + len(piece.rstrip())
            if start < stop:
                out.append({"start": start, "end": stop})
            at = m.end() if m else end
        return out

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(c)


def keyword_tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and hyphens, without stop words and numbers. A capital I with a dot is an i, as one sign."""
    words = F.regexp_extract_all(F.lower(F.translate(c, "\u0130", "i")), F.lit(r"([a-z0-9][a-z0-9\-]*)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS) & ~w.rlike(r"^[0-9]+$"))


def terminess(w: Column) -> Column:
    """How much a word looks like a term: by length, digits, hyphens, mixture and capitals."""
    n = F.length(w)
    return (
        F.least(F.lit(2.0), (n - 3) * 0.15)
        + F.when(w.rlike("[0-9]"), 0.6).otherwise(0.0)
        + F.when(w.contains("-"), 0.5).otherwise(0.0)
        + F.when(w.rlike("[0-9]") & w.rlike("[A-Za-z]"), 0.6).otherwise(0.0)
        + F.when(w.rlike("[A-Z]"), 0.4).otherwise(0.0)
    )


def between(c: Column, start: str, end: str) -> Column:
    """What stands between two marks, whatever their case; empty without both."""
    q = lambda s: r"\Q" + s + r"\E"
    return F.regexp_extract(c, rf"(?is){q(start)}\s*(.*?)\s*{q(end)}", 1)


def without_repeats(c: Column) -> Column:
    """Sentences that repeat the one before are dropped; a leading user mark and needless blanks go."""
    c = squeeze(F.regexp_replace(c, r"^\s*\|user\|:\s*", ""))
    parts = F.split(c, r"(?<=[.!?])\s+")
    kept = F.filter(parts, lambda x, i: (i == 0) | ~F.lower(x).eqNullSafe(F.lower(F.get(parts, i - 1))))
    return F.array_join(kept, " ")


def answer_line(c: Column) -> Column:
    """The first line of a generation that isn't empty or a thought, without label and quotes."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^</?think>"))
    line = F.regexp_replace(F.get(lines, F.lit(0)), r"(?i)^(rewritten query|rewrite|query|answer)\s*:\s*", "")
    return F.regexp_replace(line, "^[\"'`]+|[\"'`]+$", "")


def relaxed_json(c: Column, schema: str) -> Column:
    """A JSON object out of fences or prose: the text itself, else from its first brace to its last."""
    bare = F.trim(F.regexp_replace(c, r"```(json)?", ""))
    return F.coalesce(F.from_json(F.when(bare.startswith("{"), bare), schema), F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema))


def first_object(c: Column) -> Column:
    """Keywords of the first balanced {...}: its first list of strings, each once whatever its case, 64 at most."""
    import json


    def one(text: str | None) -> list[str]:
        at = (text or "").find("{")
        depth = 0
        for i in range(max(at, 0), len(text or "")):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if not depth:
                try:
                    found = next((v for v in json.loads(text[at : i + 1]).values() if isinstance(v, list)), [])
                except ValueError:
                    return []
                seen: dict[str, str] = {}
                for x in found:
                    if isinstance(x, str) and x.strip():
                        seen.setdefault(x.strip().lower(), x.strip())
                return list(seen.values())[:64]
        return []

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(c)


def standalone_question(c: Column) -> Column:
    """Ends with ?, has four words, and none that refers back."""
    return c.rlike(r"\?\s*$") & ~c.rlike(rf"(?i)\b({'|'.join(PRONOUNS)})\b") & (F.size(F.split(F.trim(c), r"\s+")) >= 4)


#: Words between bars that mark leaked markup. Fixed values.
MARKUP = ("document", "rank", "score", "relevance")


def garbage(c: Column) -> Column:
    """Too short, a number, a time stamp, or leaked markup."""
    t = F.trim(c)
    return (F.length(t) < 6) | t.rlike("^[0-9]+$") | t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$") | F.lower(t).rlike(r"\|(" + "|".join(MARKUP) + r")\|")


def domain(c: Column, names, pattern: str) -> Column:
    """The first of the known ``names`` that a collection's name holds, else the first group of ``pattern``; in lower case."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(low.contains(name), name).otherwise(out)
    return F.coalesce(out, F.regexp_extract(low, pattern, 1))


def idf(n: Column, df: Column, kind: str = "log", clip: bool = False) -> Column:
    x = F.log((n + 1.0) / (df + 1.0)) if kind == "log" else F.log((n - df + 0.5) / (df + 0.5))
    return F.greatest(x, F.lit(0.0)) if clip else x


def harmonic(*cs: Column, on_null: str = "null") -> Column:
    """Harmonic mean: 0 with a value that isn't positive; a null gives null, 0, or is skipped."""
    some = F.array(*cs)
    if on_null == "skip":
        some = F.array_compact(some)
    elif on_null == "zero":
        some = F.transform(some, lambda x: F.coalesce(x, F.lit(0.0)))
    mean = F.try_divide(F.size(some).cast("double"), F.aggregate(some, F.lit(0.0), lambda a, x: a + F.try_divide(F.lit(1.0), x)))
    return F.when(F.exists(some, lambda x: x.isNull()) | (F.size(some) == 0), None).when(F.exists(some, lambda x: x <= 0), 0.0).otherwise(mean)
