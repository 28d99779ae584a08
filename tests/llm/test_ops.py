"""The training-data operators against brute force, exact round trips and held-out labels, and on odd tables."""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heronlake.llm import chat, graph, html_text, licenses, mixing, ngram_join, pivot_dedup, quality_model, quality_rules, queries, sentencepiece_dropout, warc
from tests.conftest import SF
from tests.oracle import connect, rows_of, rows_of_sql

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    names, expected = rows_of_sql(con, queries.ORACLE_SQL[name])
    assert sorted(df.columns) == names and rows_of(df) == expected


def test_letters_and_form_feeds_at_both_ends(spark):
    """Texts with f and form feeds at their ends, in Spark, in SQL and by definition."""
    import duckdb

    texts = ["for all of us if", "f", "f f f", "\f a \x0b f\f", "\f", "\t\r\n", "\x0bf", "if " * 30 + "f", None, "", "\u00a0f\u2003"]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'en', 's', 0)", list(enumerate(texts)))
    rules = quality_rules.quality_rules(d).withColumn("failed_rules", F.array_join("failed_rules", ","))
    mix = mixing.mixture(d).withColumn("target", F.round("target", 6))
    assert rows_of(rules) == rows_of_sql(con, queries.ORACLE_SQL["op6_quality_rules"])[1]
    assert rows_of(mix) == rows_of_sql(con, queries.ORACLE_SQL["op8_mixing"])[1]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert {r.doc_id: (r.n_words, r.word_chars) for r in rules.collect()} == {i: (len(w), sum(map(len, w))) for i, w in enumerate(words)}
    assert {r.doc_id: r.size for r in mix.collect()} == {i: len(w) for i, w in enumerate(words)}


def test_key_ranges_are_even(spark):
    """No range of keys holds many of the documents of one size, empty ones included."""
    for n in (0, 1, 3, 400):
        d = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" w"), n - 1)).alias("text"))
        d = d.withColumn("text", F.lit("").alias("text")).where("doc_id IS NOT NULL") if n == 0 else d
        small, names = mixing.sized(d, "doc_id", "source", "text")
        assert small.groupBy(names["bucket"]).count().agg(F.max("count")).first()[0] < 20_000 / 400


ODD = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 3), (4, "one", "en", "b", 3), (4, "one", "en", "b", 3), (None, "two words", "en", "b", 9),
    (5, "x " * 30_000, "en", "a", 60_000), (6, "The of and to in is that for. " * 40, "en", "b", 9), (7, "é▁ \0 ﬁ 日本 CC-BY 4.0 all rights reserved", "en", "b", 9),
]


def odd(spark, rows=ODD):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns named as those that operators add."""
    d = spark.createDataFrame(rows, DOC)
    return d.withColumns({n: F.lit(1) for n in ("__hl_t", "__hl_size", "n_words", "score", "kept", "taken", "ids", "row", "d", "key")})


OPS = {
    "sentencepiece": lambda d: sentencepiece_dropout.encode(d), "classifier": lambda d: quality_model.classify(d), "licenses": lambda d: licenses.license_scan(d),
    "rules": lambda d: quality_rules.quality_rules(d), "mixing": lambda d: mixing.mixture(d), "join": lambda d: ngram_join.ngram_join(d),
}


#: Defined values of the odd rows, by position: words of each text, and what an operator gives.
N_WORDS = [0, 0, 0, 1, 1, 2, 30_000, 320, 9]
ODD_VALUES = {
    "sentencepiece": lambda r, i: (r.n_tokens == 0) == (ODD[i][1] in (None, "")) and r.lossless and len(r.ids) == r.n_tokens,
    "classifier": lambda r, i: (r.score == 0.0 and not r.kept and r.posterior is None) if N_WORDS[i] == 0 else 0 < r.score < 1 and r.posterior is not None,
    "licenses": lambda r, i: (r.base_labels, r.first_word, r.last_word, r.n_base) == ((["cc-by", "reserved"], 3, 7, 2) if i == 8 else ([], None, None, 0)) and r.labels == ["all-rights-reserved"] * (i == 8) + r.base_labels,
    "rules": lambda r, i: (r.n_words, r.base_failed, r.kept) == (N_WORDS[i], True, False) and r.n_repeat_words == {6: 30_000, 7: 320}.get(i, 0),
    "mixing": lambda r, i: r.size == N_WORDS[i] and r.source == ODD[i][3] and 0 <= r.taken <= 2 * r.size,
    "join": lambda r, i: r.component_id == ODD[i][0] and r.n_shingles == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 7: 8}.get(i, r.n_shingles),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_odd_and_empty_tables(spark, name):
    d = odd(spark)
    rows = OPS[name](d).collect()
    assert len(rows) == len(ODD)
    left = list(rows)
    for i, row in enumerate(ODD):  # each odd row has a result with its id and the defined values
        found = next(r for r in left if r.doc_id == row[0] and ODD_VALUES[name](r, i))
        left.remove(found)
    assert OPS[name](d.limit(0)).count() == 0


def test_classifier_with_null_or_equal_ids(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    own = {r.text: r.kept for r in quality_model.classify(d).join(d, "doc_id").collect()}
    for odd_id in (None, 7):
        same = d.withColumn("doc_id", F.lit(odd_id).cast("long"))
        model = quality_model.train(same)
        assert np.abs(model.weights).sum() > 1
        kept = {r.text for r in quality_model.filter_classified(same, model=model).select("text").collect()}
        assert sum(own[t] != (t in kept) for t in own) <= 0.03 * len(own)
    copies = d.limit(1).crossJoin(spark.range(500)).select("doc_id", "text")

    sizes, fetch = [], type(copies).toArrow
    monkeypatch.setattr(type(copies), "toArrow", lambda self: sizes.append(t := fetch(self)) or t)
    quality_model.train(copies, sample=50)
    assert 0 < sizes[-1].num_rows <= 50 and all(t.num_rows <= 50 for t in sizes)


@pytest.mark.parametrize("stage", [quality_rules.filter_quality, quality_model.filter_classified, mixing.mixed_rows])
def test_stages_keep_columns(spark, stage):
    d = odd(spark)
    out = stage(d)
    assert out.columns == d.columns
    out.collect()
    assert stage(d.limit(0)).count() == 0


def test_dropout_round_trip_and_plain_ids(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_dropout.MODEL)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plain = sentencepiece_dropout.encode(d, rate=0.0).join(d.select("doc_id", "text"), "doc_id").collect()
    assert all(r.ids == sp.encode(r.text) for r in plain)
    enc = sentencepiece_dropout.encode(d)
    rows = {r.doc_id: r for r in enc.collect()}
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in rows.values())
    assert sum(r.n_tokens for r in rows.values()) > sum(len(r.ids) for r in plain)
    again = sentencepiece_dropout.encode(d.repartition(7)).collect()
    assert all(rows[r.doc_id].ids == r.ids for r in again)  # whatever the partitions
    texts = {r.doc_id: r.text for r in d.collect()}
    assert {r.doc_id: r.text for r in sentencepiece_dropout.decode(enc).collect()} == texts
    assert len({tuple(rows[i].ids) for i in rows}) > 100


def test_agendas_agree():
    p = sentencepiece_dropout.Pieces(sentencepiece_dropout.MODEL)
    rng = random.Random(3)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("thereinoands") for _ in range(rng.randint(1, 40)))
        for below in (0, 6554, 32768):
            key = rng.getrandbits(64)
            assert sentencepiece_dropout._merged_short(word, p.rank, below, key) == sentencepiece_dropout._merged_long(word, p.rank, below, key)


@pytest.mark.parametrize("text", ["  ", " a", "a ", "a  b", "\n", " \n b \n", "a\n\nb  \n c", "\0", "x \0y", "▁", "a▁b", "日本 ｆ"])
def test_cutting_is_lossless(text):
    enc = sentencepiece_dropout.Encoder()
    assert enc.pieces.decode(np.frombuffer(enc.encode(1, text), dtype="<i4").tolist()) == text


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.train(d.join(labels, "doc_id", "left_anti"))  # no labelled document is seen in training
    r = quality_model.classify(d, model=model).join(labels, "doc_id").collect()
    good, bad = [x.kept for x in r if x.quality == 1], [x.kept for x in r if x.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1
    # without bad documents nothing is split off
    clean = d.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert quality_model.classify(clean).where("NOT kept").count() <= 0.02 * len(good)


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    n, k = 20_000, len(quality_model.LABELLERS)
    truth = rng.random(n) < 0.8
    patterns: dict[str, int] = {}
    for t in truth:
        p = "".join(str((2 if t else 0) if rng.random() < (0.97 if t else 0.7) else (0 if t else 2)) for _ in range(k))
        patterns[p] = patterns.get(p, 0) + 1
    post, acc = quality_model.estimate(patterns)
    assert all(a["on_good"] > 0.9 and 0.5 < a["on_bad"] < 0.9 for a in acc)
    assert post["2" * k] > 0.99 and post["0" * k] < 0.01


def test_html_extraction_is_exact(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(pages)).collect()}
    for p in pages:
        body = p.html.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>", body)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_html_of_other_forms():
    page = """<html><body><header><a href=x>Site</a></header><nav>Home | About</nav><div id="cookie-notice">We use cookies on this site, please do accept them all.</div>
      <div class="layout has-sidebar"><div class="content"><h2>A title</h2><p>A first paragraph that is long enough to be taken for an article, with &amp; and &eacute;.
      <p>Short.</p><p>Another paragraph, <b>bold</b>ly going on for as many words as it takes to look like text.</p></div><div class="sidebar"><p>Popular posts that you may also like to read today.</p></div></div>
      <form>Search <input></form><div class="comments"><p>First! A long comment by a reader who has a lot to say about all of this, really.</p></div><script>x("</p>")</script><footer>(c)</footer>"""
    assert html_text.main_text(page).split("\n")[0] == "A title" and html_text.main_text(page).split("\n")[2] == "Short."
    assert len(html_text.main_text(page).split("\n")) == 4
    for odd_page in (None, "", "<", "<p", "text only", "<div><div>" * 300, "<p>a</p>" * 3, "<!-- x", "<script>", "&#x110000; &nbsp;"):
        html_text.main_text(odd_page)
    assert html_text.main_text("text only") == "text only"


def test_chat_masks(spark):
    rows = [(1, 0, "user", "Hi <|end|>"), (1, 1, "\tassistant\n", "Yo"), (4, 0, "\t ", "a"), (4, 1, "x|>y<|z", "b"), (1, 2, None, "?"), (2, 0, "system", "s"), (None, None, "user", None), (3, 0, "a", "x"), (3, 0, "a", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1))
    out = chat.perspectives(d).collect()
    assert sorted((r.conv_id or 0, r.perspective) for r in out) == [(0, "user"), (1, "assistant"), (1, "unknown"), (1, "user"), (3, "a"), (4, "unknown"), (4, "x|>y<|z")]
    assert next(r for r in out if r.perspective == "unknown" and r.conv_id == 4).text == "<|assistant|>\na<|end|>\n<|user name=x\\|>y<\\|z|>\nb<|end|>\n"
    for r in out:
        spoken = [r.text[m.start : m.end] for m in r.mask]
        assert all(s.endswith("<|end|>\n") and s.count("<|end|>") == 1 for s in spoken) and r.n_chars == len(r.text)
    assert chat.perspectives(d.limit(0)).count() == 0
    long = spark.range(1000).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("role"), F.lit("t").alias("text"))
    chunks = chat.perspectives(long).groupBy("perspective").agg(F.sum("n_turns").alias("n"), F.max("n_turns").alias("m")).collect()
    assert {(r.n, r.m) for r in chunks} == {(1000, 256)}


def test_license_thresholds(spark):
    d = spark.createDataFrame([(1, "This is licensed under the Apache License version 2.0. So."), (2, "Licensed under the license."), (3, "cc\nby CC.BY"), (4, "occ by cc bye")], "doc_id long, text string")
    r = {x.doc_id: x for x in licenses.license_scan(d).collect()}
    assert r[1].labels == ["apache-2.0"] and r[2].labels == [] and r[2].score == 0
    assert (r[3].n_base, r[3].first_word, r[3].last_word, r[3].labels) == (2, 0, 2, ["cc-by"]) and r[4].n_base == 0


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def near_copies(n_groups=40, seed=5):
    """Groups of texts with few edits, of sizes around the threshold and around the borders of the size ranges."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(4000)]
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([9, 10, 11, 12, 13, 14, 20, 30, 60, 64, 65, 100, 140, 141, 300, 500]))]
        for _ in range(rng.randint(2, 14)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                t = t[: len(t) - rng.randint(0, max(1, len(t) // 12))]
            rows.append((len(rows), " ".join(t)))
    return rows


def brute_join(rows, percent=90):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    ids = [i for i, _ in rows]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, links


@pytest.mark.parametrize("block,crowd,bucket", [(512, 8, 2_000_000), (4, 2, 500)])
def test_join_equals_brute_force(spark, monkeypatch, block, crowd, bucket):
    monkeypatch.setattr(ngram_join, "CROWD", crowd)
    monkeypatch.setattr(ngram_join, "BUCKET", bucket)
    monkeypatch.setattr(ngram_join, "BLOCK", block)  # small blocks, so that clusters are dealt out
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    rows = near_copies()
    sets, links = brute_join(rows)
    expected = brute_components([i for i, _ in rows], links)
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(links) > 100 and max(map(list(expected.values()).count, set(expected.values()))) > 4  # enough to find, and clusters of several blocks
    assert {r.doc_id: r.component_id for r in got} == expected and {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_join_broadcasts_no_rows_multiplied_by_blocks(spark, monkeypatch):
    """Sets outside a cluster's largest component, times its blocks, grow with the square of the cluster: they stay off the driver."""
    monkeypatch.setattr(ngram_join, "CROWD", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    docs = spark.createDataFrame(near_copies(), "doc_id long, text string")
    sets = ngram_join.described(docs, 3)
    found = ngram_join.links(docs, sets.groupBy(F.col("d").alias("node")).agg(F.min("h").alias("h")), 100_000, 3, 90)
    lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    multiplied = [i for i, x in enumerate(lines) if re.search(r"Generate explode\((sequence|filter)", x)]
    assert len(multiplied) >= 2 and any("BroadcastExchange" in x for x in lines)  # sets and blocks are there, and tables small enough
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert not [lines[j] for j in multiplied if i < j < end]


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_enough_names(percent):
    rng = np.random.default_rng(2)
    ranges = ngram_join.Ranges(percent)
    for _ in range(400):
        n = int(rng.integers(5, 700))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
        b = a[drop:] if rng.random() < 0.5 else np.unique(np.concatenate([a[: len(a) - drop // 2], rng.integers(0, 2**63, max(0, drop // 2 - 1)).astype(np.uint64)]))
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * inter >= percent * union and inter < union:
            (x, least), (y, other) = ngram_join.signatures(a, ranges), ngram_join.signatures(b, ranges)
            assert len(np.intersect1d(x, y)) >= max(least, other) > 0


def test_components(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pivot_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    z = rng.standard_normal(base.shape)
    z -= (z * base).sum(1, keepdims=True) * base
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    pairs = 0.951 * base + np.sqrt(1 - 0.951**2) * z
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, pairs]))]
    got = pivot_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = got.where("vec_id >= 1500 AND component_id = vec_id - 1500").count()
    assert found / 1500 >= 0.98 and got.agg(F.max("n_links")).first()[0] == 1


def test_pivot_blocks_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.standard_normal(16)
    rows = [(i, [float(x) for x in v + 0.01 * rng.standard_normal(16)]) for i in range(90)]
    d = spark.createDataFrame([*rows, (200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None] * 16), (205, rows[0][1]), (206, [1.0, 2.0]), (None, rows[3][1])], "vec_id long, embedding array<double>")
    monkeypatch.setattr(pivot_dedup, "BLOCK", 16)
    r = {x.vec_id: x for x in pivot_dedup.near_dedup(d.withColumn("label", F.lit(None).cast("int"))).collect()}
    assert all(r[i].n_links == 91 and r[i].component_id == 0 for i in (*range(90), 205, None))
    assert all(r[i].n_links == 0 and r[i].component_id == i and r[i].kept for i in (200, 201, 202, 203, 204, 206))
    assert pivot_dedup.near_dedup(d.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = mixing.mixture(d).collect()
    total = sum(x.size for x in r)
    by = {}
    for x in r:
        assert 0 <= x.taken <= 2 * x.size
        by.setdefault(x.source, [x.target, x.source_size, 0])[2] += x.taken
    assert all(abs(t - taken) <= 1 and t <= 2 * size + 1e-9 for t, size, taken in by.values())
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * total)
    rows = mixing.mixed_rows(d)
    again = mixing.mixed_rows(d.repartition(5))
    assert sorted(x.doc_id for x in rows.collect()) == sorted(x.doc_id for x in again.collect())


def test_warc_round_trip_and_audit(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(9999, None, "a\r\n\r\nWARC/1.0\r\nb"), (None, "u", None)], "page_id long, url string, html string"))
    a = warc.archived(pages, 3)
    for compression in (None, "gzip"):
        warc.write_warc(a, str(tmp_path / f"w{compression}"), compression)
        back = warc.read_warc(spark, str(tmp_path / f"w{compression}")).collect()
        assert sorted(r.payload.decode() for r in back) == sorted((r.html or "") for r in pages.collect())
    lost, changed = F.col("key") == 5, F.col("key").isin(7, 30)
    b = a.where(~lost | F.col("key").isNull()).withColumn("record", F.when(changed, F.concat("record", F.lit("!"))).otherwise(F.col("record")))
    leaves_a, leaves_b = warc.leaves(a), warc.leaves(b)
    found = {(r.file, r.seq) for r in warc.suspects(leaves_a, leaves_b).collect()}
    x = {(r.file, r.seq): (r.hash, r.offset, r.length) for r in leaves_a.collect()}
    y = {(r.file, r.seq): (r.hash, r.offset, r.length) for r in leaves_b.collect()}
    assert found == {k for k in x.keys() | y.keys() if x.get(k) != y.get(k)} and found
    assert warc.audit(leaves_a, leaves_a).count() == 0
    assert warc.fixity(a.limit(0), a.limit(0)).count() == 0


def test_warc_losses_and_additions(spark):
    """One record lost, one added, two changed, one repeated; all others stay as they are."""
    url = F.concat(F.lit("u"), (F.col("id") % 7).cast("string"))
    pages = spark.range(400).select(F.col("id").alias("page_id"), url.alias("url"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("html"))
    twice = spark.createDataFrame([(None, None, "t"), (None, None, "t"), (None, None, "v")], "page_id long, url string, html string")
    pages = pages.unionByName(twice)
    a = warc.archived(pages, 2)
    more = warc.archived(spark.createDataFrame([(150, "other", "new"), (None, None, "t")], "page_id long, url string, html string"), 2)
    changed = F.col("key").isin(7, 300)
    b = a.where("NOT key <=> 33").withColumn("record", F.when(changed, F.concat("record", F.lit("!"))).otherwise(F.col("record"))).unionByName(more)
    by = Counter((r.status, r.key) for r in warc.fixity(a, b).where("status NOT IN ('ok', 'moved')").collect())
    assert by == {("missing", 33): 1, ("corrupt", 7): 1, ("corrupt", 300): 1, ("extra", 150): 1, ("extra", None): 1}
    assert warc.fixity(a, b).count() == 405
    only = Counter(r.status for r in warc.fixity(a, a.where("NOT key <=> 33")).collect())
    assert only["missing"] == 1 and only["corrupt"] == only["extra"] == 0 and sum(only.values()) == 403
    added = Counter(r.status for r in warc.fixity(a, a.unionByName(more.where("key = 150"))).collect())
    assert added["extra"] == 1 and added["corrupt"] == added["missing"] == 0


def test_warc_files_of_others(spark, tmp_path):
    """Files that gzip each record, with request records, header names in other case, and a file that is cut off."""
    import gzip

    records = [b"WARC/1.0\r\nwarc-type: %s\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nWARC-Target-URI: http://x/%d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, i, len(p), p)
               for i, (kind, p) in enumerate([(b"request", b"GET"), (b"response", b"a\r\n\r\nWARC/1.0\r\n\xff"), (b"response", b"")])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    for name in ("a.warc.gz", "b.warc"):
        own = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.seq)
        assert [(r.type, r.url, bytes(r.payload), r.date) for r in own] == [
            ("request", "http://x/0", b"GET", "2020-01-02T03:04:05Z"), ("response", "http://x/1", b"a\r\n\r\nWARC/1.0\r\n\xff", "2020-01-02T03:04:05Z"), ("response", "http://x/2", b"", "2020-01-02T03:04:05Z")
        ]
        assert [r.offset for r in own] == [0, len(records[0]), len(records[0] + records[1])]
    import io

    with pytest.raises(ValueError):
        list(warc.parsed(io.BytesIO(records[1][:-10])))


def test_dropout_draws_each_occurrence():
    enc, word, n = sentencepiece_dropout.Encoder(), "understanding", 20_000
    rng = random.Random(8)
    # as often as the agenda gives each segmentation under fresh keys, across documents and within one
    count = lambda xs: {x: c / n for x, c in Counter(xs).items()}
    expected = count(tuple(sentencepiece_dropout.segmented(" " + word, enc.pieces, 0.1, rng.getrandbits(64))) for _ in range(n))
    documents = count(tuple(np.frombuffer(x, dtype="<i4").tolist()) for x in enc.encode_many(list(range(n)), [word] * n))
    whole = " ".join([word] * n)
    ids = np.frombuffer(enc.encode("one", whole), dtype="<i4").tolist()
    assert enc.pieces.decode(ids) == whole
    starts = [i for i, x in enumerate(ids) if enc.pieces.bytes[x][:1] == b" "] + [len(ids)]
    places = count(tuple(ids[a:b]) for a, b in zip(starts, starts[1:]))
    assert len(expected) > 20
    for got in (documents, places):
        assert len(got) > 20 and all(abs(got.get(k, 0) - expected.get(k, 0)) < 0.02 for k in got.keys() | expected.keys())
    assert len(np.frombuffer(sentencepiece_dropout.Encoder(rate=1.0).encode(1, word), dtype="<i4")) == len(word) + 1
    text = " ".join([word * 5, word] * 200)  # long words, and tables that start anew
    small = sentencepiece_dropout.Encoder(kept=3)
    for i in range(3):
        assert small.pieces.decode(np.frombuffer(small.encode(i, text), dtype="<i4").tolist()) == text
        assert small.encode(i, text) == sentencepiece_dropout.Encoder().encode(i, text)


def skipping_agenda(text, rank, skipped):
    """Symbols of a marked word when the candidates with these numbers, in the order of coming up, are skipped."""
    parts, banned, seen = [(i, c) for i, c in enumerate(text)], set(), 0
    while True:
        pairs = [(rank[a + b], k) for k, ((i, a), (j, b)) in enumerate(zip(parts, parts[1:])) if a + b in rank and (i, j + len(b)) not in banned]
        if not pairs:
            return [p for _, p in parts]
        k = min(pairs)[1]
        (i, a), (j, b) = parts[k], parts[k + 1]
        if seen in skipped:
            banned.add((i, j + len(b)))
        else:
            parts[k : k + 2] = [(i, a + b)]
        seen += 1


def test_dropout_against_a_plain_agenda():
    """Every word of real texts, rebuilt from its draws alone, at several rates."""
    import duckdb
    import xxhash

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 6").fetchall()] + ["▁x  ▁ \n日本語 naïve\0z\u2028 \U0001f600" * 3]
    for rate in (0.1, 0.5):
        enc = sentencepiece_dropout.Encoder(rate=rate)
        for doc, got in enumerate(enc.encode_many(list(range(len(texts))), texts)):
            key = np.array([xxhash.xxh3_64_intdigest(str(doc).encode(), seed=sentencepiece_dropout.SEED)], dtype=np.uint64)
            expected, words = [], sentencepiece_dropout.cut(texts[doc])
            drawn = [enc._merges(key, np.arange(len(words)), np.array([turn])).tolist() for turn in range(100)]
            for place, w in enumerate(words):
                if len(w) > sentencepiece_dropout.LONG:
                    h = xxhash.xxh3_64_intdigest(w.encode(), seed=(int(key[0]) + place * sentencepiece_dropout._A) & (2**64 - 1))
                    expected += sentencepiece_dropout.segmented(sentencepiece_dropout.uncut(w), enc.pieces, rate, h)
                    continue
                skipped, at = set(), -1
                for turn in drawn:
                    at += 1 + turn[place]
                    skipped.add(at)
                expected += sentencepiece_dropout._ids(skipping_agenda(sentencepiece_dropout._marked(sentencepiece_dropout.uncut(w)), enc.pieces.rank, skipped), enc.pieces)
            assert np.frombuffer(got, dtype="<i4").tolist() == expected


def test_html_drops_no_article_text():
    line = lambda n, c="x": f"<p>{c * n}</p>"
    ad, box = '<div class="advert">Buy now, as long as there is any of it left.</div>', '<div class="newsletter">Your address, please.</div>'
    lengths = lambda page: [len(x) for x in html_text.main_text(page).split("\n")]
    for inner, expected in (
        (line(200) + ad + box + line(90), [200, 90]), (line(200) + ad + line(30) + line(20), [200, 30, 20]), (line(30) + line(31), [30, 31]),
        (line(200) + "<p><a href=x>" + "y" * 25 + "</a></p>" + line(90), [200, 25, 90]), (line(200) + "<p><a href=x>" + "y" * 25 + "</a></p>" + line(30), [200, 25, 30]),
        (line(500) + "<ul>" + "<li><a href=x>yyyy</a></li>" * 4 + "</ul>" + line(100), [500, 4, 4, 4, 4, 100]),
    ):
        assert lengths(f'<body><nav><a href=x>Home</a></nav><div class="content">{inner}</div><footer>(c)</footer></body>') == expected


def surge_and_dive(lengths, window=3, surge=80):
    """By the definition, position by position: kept are lines from the first surge, with those before it that touch it, to the
    last position behind a surge from which on windows are empty."""
    n = len(lengths)
    at = [i for i in range(n) if sum(lengths[i : i + window]) >= surge and lengths[i] > 0]
    if not at:
        return list(range(n))
    kept = set(range(min(at), max(at) + 1))
    for i in range(min(at) - 1, -1, -1):
        if not lengths[i]:
            break
        kept.add(i)
    for i in range(max(at), n):
        if not sum(lengths[i : i + window]):
            break
        kept.add(i)
    return sorted(kept)


def test_html_against_brute_force():
    """Pages with and without an article, adverts and menus between paragraphs, and links of all sizes."""
    rng = random.Random(12)
    for _ in range(300):
        blocks, words = [], lambda: " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([1, 2, 5, 40])))
        for _ in range(rng.randint(0, 14)):
            kind = rng.choice(["text", "text", "text", "link", "dropped"])
            blocks.append((kind, words()))
        html_of = {"text": "<p>{}</p>", "link": "<p><a href=x>{}</a></p>", "dropped": '<div class="ad"><p>{}</p></div>'}
        inner = "".join(html_of[k].format(t) for k, t in blocks)
        shown = [(k, t) for k, t in blocks if k != "dropped"]
        keep = surge_and_dive([len(t) if k == "text" else 0 for k, t in shown])
        assert html_text.main_text(f"<body><nav>Menu</nav><div>{inner}</div></body>") == "\n".join(shown[i][1] for i in keep)
        around = f"<p>{words()}</p>"
        assert html_text.main_text(f"<body>{around}<article>{inner}</article>{around}</body>") == "\n".join(t for _, t in shown) or not shown


def test_html_keeps_articles_that_look_like_parts():
    long = "x" * 120
    for article in (f'<p class="notice">{long}</p>', f'<section id="search"><p>{long}</p></section>'):
        assert html_text.main_text(f"<body><nav>Menu</nav><article>{article}<p>End.</p></article></body>") == f"{long}\nEnd."
        assert html_text.main_text(f'<body><div class="side-by-side">{article.replace("notice", "x").replace("search", "y")}</div></body>') == long


@pytest.mark.parametrize("page", ["<a" * 500_000, "<div>" * 50_000 + "</span>" * 50_000, '<a "' * 250_000, "<!" * 500_000, "<p>" + "x<" * 400_000, "<a x='" + '<b y="' * 150_000, "<i>" * 50_000 + "</b>" * 50_000])
def test_html_takes_linear_time(page):
    import time

    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 10


def test_html_null_pages(spark):
    d = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "u", "<p>a</p>"), (2, "u", "<p>a</p>")], "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("n_chars", F.lit("y"))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract(d).collect()) == [(0, "", 0), (1, "", 0), (2, "a", 1), (2, "a", 1)]


def test_every_template_gets_its_own_label(spark):
    rows = [(i, f"Some words before. {t}. Some words behind.") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(100, "See the Mozilla Public License, v.\n  2.0! This Source Code Form is subject to it."), (101, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 3.0")]
    r = {x.doc_id: x for x in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in r[i].labels and r[i].score == 1.0
    assert r[100].labels == [] and r[101].labels == []
    own = licenses.license_scan(spark.createDataFrame([(1, "Say no. You may not copy this."), (2, "Say no. It may. Not copy this you.")], "doc_id long, text string"), templates=(("own", "No. You may not copy this"),))
    assert {x.doc_id: x.labels for x in own.collect()} == {1: ["own"], 2: []}
