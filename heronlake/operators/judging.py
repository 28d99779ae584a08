"""Parsing of judges' outputs, text-overlap metrics, and metrics that depend on refusals."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions.text import norm_qa

#: Where a rating stands in a judge's answer, whatever the case; of all that match, the last of this list wins, with its first
#: place. Fixed values.
RATINGS = (
    r"Rating: \[\[(\d+)\]\]",
    r"Rating: (\d+)",
    r"\[\[(\d+)\]\]",
    r"\[(\d+)\]",
    r"Rating: \[\[([0-9]*\.?[0-9]+)\]\]",
    r"Overall Rating: ([0-9]*\.?[0-9]+)",
    r"Score: ([0-9]*\.?[0-9]+)/10",
    r"Score: ([0-9]*\.?[0-9]+)",
    r"\[Rating\]\n(\d+)",
    r"Rating: \[\[(\d+)/10\]\]",
    r"Rating: \[\[([-+]?\d*\.?\d+)",
    r"([-+]?\d*\.?\d+) out of 10",
)
#: What follows this on its line is an example and no rating. Fixed value.
EXAMPLE = r"for example:.*?$"
#: Where a judge's JSON has its rating; the first that is there counts. Fixed values.
RATING_KEYS = ("rating", "score", "RB_llm", "rb_llm")
#: Score of each outcome without a rating. Fixed values.
ERROR_SCORES = {"EMPTY_ANSWER": 0.0, "EMPTY_CONTEXT": 0.0, "API_ERROR": 0.5, "PARSE_ERROR": 0.5}


def stated(c: Column) -> Column:
    """The rating over 10 that an answer states, whatever it is; null without one."""
    t = F.regexp_replace(c, "(?im)" + EXAMPLE, "")
    return F.coalesce(*[F.nullif(F.regexp_extract(t, "(?i)" + p, 1), F.lit("")).try_cast("double") for p in reversed(RATINGS)]) / 10


def rating(c: Column) -> Column:
    """The rating over 10; 0.5 without one, or with one outside of (0, 1]."""
    r = stated(c)
    return F.when((r > 0) & (r <= 1), r).otherwise(0.5)


def rating_or_code(answer: Column, has_context: Column | None = None, failed: Column | None = None) -> Column:
    """struct<score, code>: OK with the rating of a JSON answer, clamped to 0..1, or of a plain one; without one an
    error code and its score."""
    t = F.trim(answer)
    facts = F.struct(F.coalesce(t, F.lit("")).alias("text"), stated(t).alias("stated"), F.array(*[F.get_json_object(t, f"$.{k}").try_cast("double") for k in RATING_KEYS]).alias("keys"))

    def of(x: Column) -> Column:
        key = F.get(F.array_compact(x["keys"]), F.lit(0))
        plain = F.when((x["stated"] > 0) & (x["stated"] <= 1), x["stated"]).otherwise(0.5)
        found = F.when(key.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), key))).when(x["stated"].isNotNull(), plain)
        code = F.when(F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False), "API_ERROR")
        if has_context is not None:
            code = code.when(~has_context, "EMPTY_CONTEXT")
        return F.struct(found.alias("found"), code.when(x["text"] == "", "EMPTY_ANSWER").when(found.isNull(), "PARSE_ERROR").otherwise("OK").alias("code"))

    # bound by lambdas, so that the patterns are searched for once and the generated code stays small
    coded = F.transform(F.array(facts), of)
    default = F.create_map(*[F.lit(x) for pair in ERROR_SCORES.items() for x in pair])
    return F.transform(coded, lambda x: F.struct(F.when(x["code"] == "OK", x["found"]).otherwise(F.try_element_at(default, x["code"])).alias("score"), x["code"].alias("code")))[0]


def faithfulness(claims: Column, own: Column | None = None) -> Column:
    """1 - unsupported share - half the unverifiable share, within 0..1, over an array of labels; 0 without claims. A
    judge's own score within 0..1 goes first."""
    n = F.size(claims)
    bad = F.size(F.filter(claims, lambda x: x == "not_supported"))
    vague = F.size(F.filter(claims, lambda x: x == "unverifiable"))
    score = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - bad / n - F.lit(0.5) * vague / n))).otherwise(0.0)
    return score if own is None else F.when(own.between(0, 1), own).otherwise(score)


def idk_label(c: Column) -> Column:
    """yes, no, partial or parse_error, from the letters of an answer."""
    t = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.when(t.startswith("yes"), "yes").when(t.startswith("no"), "no").when(t.startswith("partial"), "partial").otherwise("parse_error")


def idk_score(label: Column) -> Column:
    return F.when(label == "yes", 1.0).when(label == "no", 0.0).otherwise(0.5)


def idk_token(c: Column) -> Column:
    """1 for yes, 0 for no, 0.5 for another first word, null without any."""
    w = F.lower(F.regexp_extract(c, r"([A-Za-z]+)", 1))
    return F.when(w == "yes", 1.0).when(w == "no", 0.0).when(w != "", 0.5)


def idk_norm(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return (
        F.when(c.isNull() | (t == ""), "missing").when(t.isin("yes", "y", "1", "1.0", "true"), "yes").when(t.isin("no", "n", "0", "0.0", "false"), "no").when(t.isin("partial", "0.5", "partially"), "partial").otherwise(t)
    )


def eval_group(c: Column) -> Column:
    """From an answerability cell: UNANSWERABLE holds ANSWERABLE, so it is asked first."""
    t = F.upper(c)
    return F.when(t.contains("CONVERSATIONAL"), "conversational").when(t.contains("UNANSWERABLE"), "unanswerable").when(t.contains("ANSWERABLE") | t.contains("PARTIAL"), "answerable_partial").otherwise("unknown")


def idk_correct(group: Column, label: Column, partial_as_idk: bool = False) -> Column:
    answered = label.isin("no") if partial_as_idk else label.isin("no", "partial")
    return F.when(group == "answerable_partial", answered.cast("double")).when(group == "unanswerable", (label == "yes").cast("double"))


def idk_condition(group: Column, label: Column, metric: Column, policy: str = "strict") -> Column:
    """The metric in the light of a refusal. strict: answered questions keep it, refused ones get 0, refused unanswerable
    ones 1, conversational none. official: conversational ones are as unanswerable ones."""
    if policy == "official":
        idk = idk_score(label)
        return F.when(group.isin("unanswerable", "conversational"), F.when(idk == 1, 1.0).otherwise(0.0)).otherwise(F.when(idk == 1, 0.0).otherwise(metric))
    return F.when(group == "answerable_partial", F.when(label.isin("no", "partial"), metric).when(label == "yes", 0.0)).when(group == "unanswerable", F.when(label == "yes", 1.0).when(label.isin("no", "partial"), 0.0))


def judge_quality(group: Column, label: Column) -> Column:
    """Whether a judge's label fits the question; 0 if it couldn't be read."""
    return F.when(label == "parse_error", 0.0).when(group.isin("unanswerable", "conversational"), (label == "yes").cast("double")).when(group == "answerable_partial", label.isin("no", "partial").cast("double"))


def counted(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, token, n of normalised texts."""
    return df.select(key, F.explode(F.filter(F.split(norm_qa(text), " "), lambda w: w != "")).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def token_overlap(df: DataFrame, key: str, prediction: Column, target: Column) -> DataFrame:
    """key, recall, precision: tokens in common, as often as both have them, over the target's and the prediction's."""
    p, t = counted(df, key, prediction).withColumnRenamed("n", "np"), counted(df, key, target).withColumnRenamed("n", "nt")
    both = p.join(t, [key, "token"], "full_outer").fillna(0, ["np", "nt"]).groupBy(key)
    both = both.agg(F.sum(F.least("np", "nt")).alias("c"), F.sum("np").alias("p"), F.sum("nt").alias("t"))
    d = df.select(key).join(both, key, "left").fillna(0, ["c", "p", "t"])
    return d.select(key, F.coalesce(F.try_divide("c", "t"), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide("c", "p"), F.lit(0.0)).alias("precision"))


def rouge_l(df: DataFrame, key: str, prediction: Column, target: Column) -> DataFrame:
    """key, rouge_l: F-measure of the longest common subsequence of [a-z0-9]+ tokens. Bit-parallel over one text, so a
    pair takes time in the length of the other."""
    import re

    words = re.compile(r"[a-z0-9]+")

    def one(a: str | None, b: str | None) -> float:
        x, y = words.findall((a or "").lower()), words.findall((b or "").lower())
        if not x or not y:
            return 0.0
        at: dict[str, int] = {}
        for i, w in enumerate(x):
            at[w] = at.get(w, 0) | (1 << i)
        full = row = (1 << len(x)) - 1
        for w in y:
            m = row & at.get(w, 0)
            row = ((row + m) | (row - m)) & full
        n = len(x) - row.bit_count()
        p, r = n / len(x), n / len(y)
        return 2 * p * r / (p + r) if n else 0.0

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            pdf["rouge_l"] = [one(a, b) for a, b in zip(pdf["p"], pdf["t"])]
            yield pdf[[key, "rouge_l"]]

    d = df.select(key, prediction.alias("p"), target.alias("t"))
    return d.mapInPandas(run, f"{key} {d.schema[key].dataType.simpleString()}, rouge_l double")


def rb_agg(bert_r: Column, rouge: Column, k_prec: Column, recall: Column | None = None) -> Column:
    """Harmonic mean of (BertR + 1) / 2 (or token recall without it), Rouge-L and (largest K-precision + 1) / 2; 0 if one is 0."""
    a = F.coalesce((bert_r + 1) / 2, recall) if recall is not None else (bert_r + 1) / 2
    c = F.coalesce((F.array_max(k_prec) + 1) / 2, F.lit(0.0))
    return F.when((a > 0) & (rouge > 0) & (c > 0), F.lit(3.0) / (1 / a + 1 / rouge + 1 / c)).otherwise(0.0)


def extractive(df: DataFrame, key: str, prediction: Column, target: Column) -> DataFrame:
    """key, value: 1 if the target, without blanks, stands in the prediction; else Rouge-L."""
    inside = F.replace(prediction, F.lit(" "), F.lit("")).contains(F.replace(target, F.lit(" "), F.lit("")))
    r = rouge_l(df, key, prediction, target).join(df.select(key, inside.alias("inside")), key)
    return r.select(key, F.when(F.col("inside"), 1.0).otherwise(F.col("rouge_l")).alias("value"))


def _bert(part: str):
    from heronlake.functions.providers import bert_score

    return lambda df, key, p, t: df.select(key, bert_score(p, t)[part].alias("value"))


#: Scorers by the names that a configuration uses: (df, key, prediction, target) -> key, value.
SCORERS = {
    "recall": lambda df, key, p, t: token_overlap(df, key, p, t).select(key, F.col("recall").alias("value")),
    "rouge_l": lambda df, key, p, t: rouge_l(df, key, p, t).withColumnRenamed("rouge_l", "value"),
    "bert_prec": _bert("precision"),
    "bert_recall": _bert("recall"),
    "extractiveness_rouge": extractive,
    "length": lambda df, key, p, t: df.select(key, F.length(p).cast("double").alias("value")),
}
#: Columns of a task that a metric's target may name.
TARGETS = {"target": "targets", "passage": "passages", "target_label": "labels"}
#: The metrics that the aggregate needs: token recall, Rouge-L, BERT recall, BERT K-precision. Fixed names.
AGGREGATED = ("Recall", "RougeL_stemFalse", "BertscoreR", "BertKPrec")


def metric_config(text: str) -> dict[str, dict[str, str]]:
    """A configuration of two levels: a metric's name, then func, prediction and target, indented, each as ``name: value``."""
    out: dict[str, dict[str, str]] = {}
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        name, colon, value = body.strip().partition(":")
        if not body:
            continue
        if not colon or (body[0].isspace() and not out):
            raise ValueError(f"not a name and a value: {line!r}")
        if body[0].isspace():
            out[list(out)[-1]][name.strip()] = value.strip()
        else:
            out[name.strip()] = {}
    return out


def dispatch(tasks: DataFrame, key: str, config: dict[str, dict[str, str]]) -> DataFrame:
    """key, metric, values: the metrics of ``config`` for tasks (a unique key, prediction, and arrays targets, passages, labels as
    the metrics need), one value for each target in its order, none without targets. RB_agg, one value, is added if the four
    metrics that it needs are there: from the first recall and Rouge-L and all K-precisions. Null predictions count as empty.
    Unknown scorers or targets raise."""
    for name, m in config.items():
        if m.get("func") not in SCORERS or m.get("target") not in TARGETS or m.get("prediction", "prediction") != "prediction":
            raise ValueError(f"metric {name}: unknown scorer, prediction or target in {m}")
    c, found = F.col, None
    kind = tasks.schema[key].dataType
    for target in dict.fromkeys(m["target"] for m in config.values()):
        x = tasks.select(c(key), F.coalesce("prediction", F.lit("")).alias("p"), F.posexplode(TARGETS[target]).alias("i", "t"))
        x = x.select(F.concat(c(key).cast("string"), F.lit("#"), c("i").cast("string")).alias("pair"), "p", F.coalesce("t", F.lit("")).alias("t"))
        for name in (n for n, m in config.items() if m["target"] == target):
            d = SCORERS[config[name]["func"]](x, "pair", c("p"), c("t")).select("pair", F.lit(name).alias("metric"), "value")
            found = d if found is None else found.unionByName(d)
    names = [*config] + ["RB_agg"] * all(n in config for n in AGGREGATED)
    rows = tasks.select(key, F.explode(F.array(*map(F.lit, names))).alias("metric")) if names else tasks.select(key, F.lit("").alias("metric")).limit(0)
    if found is None:
        return rows.withColumn("values", F.array().cast("array<double>"))
    place = F.substring_index("pair", "#", -1)
    back = F.expr("substring(pair, 1, length(pair) - length(substring_index(pair, '#', -1)) - 1)").cast(kind)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda v: v["value"])
    values = found.select(back.alias(key), "metric", place.cast("int").alias("i"), "value").groupBy(key, "metric").agg(listed.alias("values"))
    if "RB_agg" in names:
        recall, rouge, bert, k = (F.max(F.when(c("metric") == n, c("values"))) for n in AGGREGATED)
        g = values.where(c("metric").isin(*AGGREGATED)).groupBy(key).agg(recall.alias("__recall"), rouge.alias("__rouge"), bert.alias("__bert"), k.alias("__k"))
        k0 = F.transform("__k", lambda v: F.coalesce(v, F.lit(0.0)))
        agg = rb_agg(F.get("__bert", F.lit(0)), F.get("__rouge", F.lit(0)), k0, F.get("__recall", F.lit(0)))
        values = values.unionByName(g.select(key, F.lit("RB_agg").alias("metric"), F.array(agg).alias("values")))
    return rows.join(values, [key, "metric"], "left").withColumn("values", F.coalesce("values", F.array().cast("array<double>")))
