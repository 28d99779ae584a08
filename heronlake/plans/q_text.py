"""Queries of the text functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions import text as tx
from heronlake.plans.registry import query
from heronlake.sources.scratch import table

_SENT = r"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_STOPS = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
_PRON = "it|they|this|that|these|those|he|she|them|him|her|back then"
#: Lines of page furniture behind every text, some of which only look like it.
_MORE = ["", " X ", "saving your location allows us to provide you with more relevant information!", "Set Locations", "please set location", "xx", "\u00d7", "Office of the Patient Advocate - State of California", "end"]
_PUNCT = tx.PUNCTUATION.replace("'", "''")
_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_ASCII = r"(CASE WHEN length({t}) > 0 THEN length(regexp_replace({t}, '[^\x00-\x7F]', '', 'g')) / length({t}) ELSE 0 END)"
_KW = rf"list_filter(regexp_extract_all(lower({{t}}), '[a-z0-9][a-z0-9\-]*'), lambda w: w NOT IN ({_STOPS}) AND NOT regexp_matches(w, '^[0-9]+$'))"
_TERM = (
    "(least(2.0, (length({w}) - 3) * 0.15) + CASE WHEN regexp_matches({w}, '[0-9]') THEN 0.6 ELSE 0 END + CASE WHEN contains({w}, '-') THEN 0.5 ELSE 0 END"
    " + CASE WHEN regexp_matches({w}, '[0-9]') AND regexp_matches({w}, '[A-Za-z]') THEN 0.6 ELSE 0 END + CASE WHEN regexp_matches({w}, '[A-Z]') THEN 0.4 ELSE 0 END)"
)

#: Texts by their length, among them time stamps, numbers, markup and others that only look like these.
_FORMS = ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z now", "1234567", "12345 67", "a |RANK| b", "|assistant| x", "x |Score| y", "|relevance|", "|document|!", "short")
_MADE = "CASE length(text) % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FORMS)) + " ELSE text END"


def _made(c):
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in _FORMS]), (F.length(c) % 11).cast("int")), c)


# name: (function of the text column, SQL with {t} for the text)
SCALARS = {
    "fn_norm_qa": (tx.norm_qa, "array_to_string(list_filter(regexp_split_to_array(" + _SQUEEZE.replace("{}", f"translate(lower({{t}}), '{_PUNCT}', '')") + ", ' '), lambda w: w NOT IN ('a', 'an', 'the')), ' ')"),
    "fn_norm_dedup": (
        lambda c: tx.norm_dedup(F.concat(c, F.lit("\n".join(_MORE)))),
        _SQUEEZE.replace('{}', "array_to_string(list_filter(string_split({t} || '" + "' || chr(10) || '".join(_MORE) + r"', chr(10)), lambda x: NOT regexp_matches(trim(x), '(?i)Saving your location allows us to provide you with more relevant information|\bSet Location\b|Office of the Patient Advocate - State of California|^\s*[×x]\s*$')), ' ')"),
    ),
    "fn_norm_query": (tx.norm_query, _SQUEEZE.replace('{}', r"regexp_replace(lower({t}), '[^\p{L}\p{N}_\s''-]', '', 'g')")),
    "fn_strip_newline": (tx.strip_newline, r"lower(regexp_replace(replace({t}, chr(10), ' '), '[^\p{L}\p{N}_\s]', '', 'g'))"),
    "fn_strip_user": (tx.strip_user, r"array_to_string(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '^\s*\|user\|:\s*', ''))), chr(10))"),
    "fn_sent_split": (
        lambda c: F.array_join(tx.sentences(c), "¦"),
        "array_to_string(list_filter(list_transform(flatten(list_transform(string_split({t}, chr(10) || chr(10)), lambda p: " + _SENT.replace('{t}', "p") + ")), lambda x: trim(x)), lambda x: x <> ''), '¦')",
    ),
    "fn_sent_split_ctx": (
        lambda c: F.array_join(tx.context_sentences(c), "¦"),
        r"array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1:30], '¦')",
    ),
    "fn_lang_detect": (
        lambda c: F.concat_ws("|", tx.language(c)["lang"], F.format_string("%.4f", F.floor(tx.language(c)["score"] * 1e4 + 1e-6) / 1e4)),
        r"(CASE WHEN trim(regexp_replace({t}, '\s+', ' ', 'g')) = '' THEN 'unk' WHEN " + _ASCII + r" > 0.9 THEN 'en_like' WHEN regexp_matches({t}, '[\x{0400}-\x{04FF}]') THEN 'ru_like'"
        r" WHEN regexp_matches({t}, '[\x{4E00}-\x{9FFF}]') THEN 'zh_like' ELSE 'non_en_like' END) || '|' || format('{:.4f}', floor((CASE WHEN trim(regexp_replace({t}, '\s+', ' ', 'g')) = '' THEN 0"
        r" WHEN " + _ASCII + " > 0.9 THEN " + _ASCII + r" WHEN regexp_matches({t}, '[\x{0400}-\x{04FF}\x{4E00}-\x{9FFF}]') THEN 1 ELSE 1 - " + _ASCII + " END) * 1e4 + 1e-6) / 1e4)",
    ),
    "fn_non_en_line": (
        lambda c: F.size(F.filter(F.split(c, "\n"), tx.non_english_line)).cast("long"),
        r"len(list_filter(string_split({t}, chr(10)), lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) < 3 AND (length(regexp_replace(x, '[^\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{0400}-\x{04FF}]', '', 'g')) >= 3"
        r" OR (length(x) > 0 AND length(regexp_replace(x, '[\x00-\x7F]', '', 'g')) / length(x) >= 0.4))))::BIGINT",
    ),
    "fn_tokenize_kw": (lambda c: F.array_join(tx.keyword_tokens(c), " "), "array_to_string(" + _KW + ", ' ')"),
    "fn_terminess": (
        lambda c: F.round(F.aggregate(tx.keyword_tokens(c), F.lit(0.0), lambda a, w: a + tx.terminess(w).cast("double")), 4),
        "round(coalesce(list_sum(list_transform(" + _KW + ", lambda w: " + _TERM.format(w="w") + "::DOUBLE)), 0), 4)",
    ),
    "fn_extract_between": (
        lambda c: tx.between(F.concat(F.lit("[question] "), c, F.lit("\n[ANSWER] none")), "[Question]", "[Answer]"),
        r"regexp_extract('[question] ' || {t} || chr(10) || '[ANSWER] none', '(?is)\[question\]\s*(.*?)\s*\[answer\]', 1)",
    ),
    "fn_clean_question": (
        tx.without_repeats,
        "(WITH s AS (SELECT " + _SENT.replace('{t}', _SQUEEZE.replace('{}', "regexp_replace({t}, '^\\s*\\|user\\|:\\s*', '')")) + " AS p) SELECT array_to_string(list_transform(list_filter(range(1, len(p) + 1), lambda i: i = 1 OR lower(p[i]) <> lower(p[i - 1])), lambda i: p[i]), ' ') FROM s)",
    ),
    "fn_clean_gen": (
        lambda c: tx.answer_line(F.concat(F.lit("\n<think>\nRewritten query: \""), c, F.lit('"'))),
        r"""regexp_replace(regexp_replace(list_filter(list_transform(string_split(chr(10) || '<think>' || chr(10) || 'Rewritten query: "' || {t} || '"', chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^</?think>'))[1],"""
        r""" '(?i)^(rewritten query|rewrite|query|answer)\s*:\s*', ''), '^["''`]+|["''`]+$', '', 'g')""",
    ),
    "fn_json_relaxed": (
        lambda c: tx.relaxed_json(F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(c.alias("answer"))), F.lit("\n```")), "answer string")["answer"],
        "{t}",
    ),
    "fn_ctx_text": (
        lambda c: F.array_join(F.transform(F.slice(F.split(c, "\n"), 1, 5), lambda x: F.when(F.length(tx.squeeze(x)) > 1400, F.concat(F.substring(tx.squeeze(x), 1, 1400), F.lit(" ..."))).otherwise(tx.squeeze(x))), "\n\n"),
        "array_to_string(list_transform(string_split({t}, chr(10))[1:5], lambda x: CASE WHEN length(" + _SQUEEZE.replace('{}', "x") + ") > 1400 THEN " + _SQUEEZE.replace('{}', "x") + "[1:1400] || ' ...' ELSE " + _SQUEEZE.replace('{}', "x") + " END), chr(10) || chr(10))",
    ),
    "fn_docs_block": (
        lambda c: F.concat(F.lit("Documents:\n"), F.array_join(F.transform(F.split(c, "\n"), lambda x, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("]\n"), F.trim(x))), "\n")),
        "'Documents:' || chr(10) || array_to_string(list_transform(string_split({t}, chr(10)), lambda x, i: '[Document ' || i || ']' || chr(10) || trim(x)), chr(10))",
    ),
    "fn_hash_key": (F.sha1, "sha1({t})"),
    "prd_standalone_q": (
        lambda c: tx.standalone_question(F.concat(c, F.lit("?"))),
        rf"(NOT regexp_matches({{t}}, '(?i)(^|[^0-9A-Za-z_])({_PRON})($|[^0-9A-Za-z_])') AND len(regexp_split_to_array(trim({{t}} || '?'), '\s+')) >= 4)",
    ),
    "prd_garbage": (
        lambda c: tx.garbage(_made(c)),
        f"(length(trim({_MADE})) < 6 OR regexp_matches(trim({_MADE}), '^[0-9]+$') OR regexp_matches(trim({_MADE}), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z$') OR contains(lower({_MADE}), '|document|') OR contains(lower({_MADE}), '|rank|') OR contains(lower({_MADE}), '|score|') OR contains(lower({_MADE}), '|relevance|'))".replace("{t}", "text"),
    ),
}


def _scalar(name: str, f, sql: str) -> None:
    @query(name, f"SELECT doc_id, {sql.replace('{t}', 'text')} AS value FROM documents")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("value"))


for _name, (_f, _sql) in SCALARS.items():
    _scalar(_name, _f, _sql)


@query("fn_nfkc_clean")
def fn_nfkc_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_mixed(tx.nfkc(F.col("text"))).alias("value"))


@query("fn_clean_html")
def fn_clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.clean_html(F.col("html")).alias("value"))


@query("fn_span_split")
def fn_span_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.spans(F.col("text"))).alias("i", "span")).select("doc_id", "i", "span.start", "span.end")


@query("fn_json_first_obj")
def fn_json_first_obj(spark, sf_dir):
    words = tx.keyword_tokens(F.col("text"))
    made = F.concat(F.lit("Here: "), F.to_json(F.struct(words.alias("keywords"))), F.lit(" {ok}"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.first_object(made), " ").alias("value"))


@query("fn_idf", "WITH t AS (SELECT n_nationkey AS k, (n_nationkey + 1)::DOUBLE AS df, 25.0::DOUBLE AS n FROM nation) SELECT k, round(ln((n + 1) / (df + 1)), 6) AS log_idf, round(ln((n - df + 0.5) / (df + 0.5)), 6) AS bm25_idf, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 0), 6) AS clipped FROM t")
def fn_idf(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 1).cast("double").alias("df"), F.lit(25.0).alias("n"))
    n, df = F.col("n"), F.col("df")
    return d.select("k", F.round(tx.idf(n, df), 6).alias("log_idf"), F.round(tx.idf(n, df, "bm25"), 6).alias("bm25_idf"), F.round(tx.idf(n, df, "bm25", True), 6).alias("clipped"))


@query(
    "fn_hm",
    """WITH v AS (SELECT doc_id, n_chars / 4000.0::DOUBLE AS a, (CASE WHEN lang = 'fr' THEN NULL ELSE 0.5 END)::DOUBLE AS b, (CASE WHEN source = 'src0' THEN 0 ELSE 0.25 END)::DOUBLE AS c FROM documents)
SELECT doc_id, round(CASE WHEN b IS NULL THEN NULL WHEN least(a, b, c) <= 0 THEN 0 ELSE 3 / (1 / a + 1 / b + 1 / c) END, 6) AS strict,
 round(CASE WHEN least(a, c) <= 0 OR coalesce(b, 1) <= 0 THEN 0 WHEN b IS NULL THEN 2 / (1 / a + 1 / c) ELSE 3 / (1 / a + 1 / b + 1 / c) END, 6) AS skipping,
 round(CASE WHEN least(a, c) <= 0 OR coalesce(b, 0) <= 0 THEN 0 ELSE 3 / (1 / a + 1 / b + 1 / c) END, 6) AS zeroed FROM v""",
)
def fn_hm(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 4000.0).alias("a"), F.when(F.col("lang") != "fr", 0.5).alias("b"), F.when(F.col("source") == "src0", 0.0).otherwise(0.25).alias("c"))
    cs = [F.col(x) for x in "abc"]
    return d.select("doc_id", *[F.round(tx.harmonic(*cs, on_null=k), 6).alias(name) for k, name in (("null", "strict"), ("skip", "skipping"), ("zero", "zeroed"))])


@query("fn_percentile_lin", "SELECT source, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY source")
def fn_percentile_lin(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.percentile("n_chars", 0.9), 6).alias("p90"), F.round(F.percentile("n_chars", 0.99), 6).alias("p99"))


@query("fn_weighted_avg", "WITH x AS (SELECT lang, n_chars::DOUBLE AS w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1)::BIGINT - 1 AS i FROM documents JOIN embeddings ON doc_id = vec_id) SELECT lang, i, round(sum(v * w) / sum(w), 6) AS value FROM x GROUP BY lang, i")
def fn_weighted_avg(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    d = d.select("lang", F.col("n_chars").cast("double").alias("w"), F.posexplode("embedding").alias("i", "v"))
    return d.groupBy("lang", F.col("i").cast("long").alias("i")).agg(F.round(F.sum(F.col("v").cast("double") * F.col("w")) / F.sum("w"), 6).alias("value"))


@query("fn_overlap", "SELECT l_orderkey, l_linenumber, greatest(0, least(l_linenumber * 100 + l_quantity::BIGINT, 300) - greatest(l_linenumber * 100, 120))::BIGINT AS value FROM lineitem")
def fn_overlap(spark, sf_dir):
    s = F.col("l_linenumber") * 100
    overlap = F.greatest(F.lit(0), F.least(s + F.col("l_quantity").cast("long"), F.lit(300)) - F.greatest(s, F.lit(120)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", overlap.cast("long").alias("value"))


@query("prj_domain", "SELECT doc_id, CASE WHEN n_chars < 900 THEN 'wiki' WHEN lang = 'en' THEN 'bank' WHEN lang = 'fr' THEN 'state' ELSE 'xyz' END AS value FROM documents")
def prj_domain(spark, sf_dir):
    name = F.when(F.col("n_chars") < 900, "set-WIKI-dense").when(F.col("lang") == "en", "set-bank-sparse").when(F.col("lang") == "fr", "STATE_help").otherwise("set-xyz-dense")
    return table(spark, sf_dir, "documents").select("doc_id", tx.domain(name, ("wiki", "bank", "state", "help"), "set-([a-z]+)-").alias("value"))


@query("prj_title_text", "SELECT doc_id, trim((CASE WHEN lang = 'en' THEN source ELSE '' END) || ' ' || text) AS value FROM documents")
def prj_title_text(spark, sf_dir):
    title = F.when(F.col("lang") == "en", F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(F.col("text"), F.lit("")))).alias("value"))
