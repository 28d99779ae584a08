"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

from heronlake.llm.quality_rules import STOP_WORDS

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

QUALITY_FEATURES = rf"""
base AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {{docs}}),
worded AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
                  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM base),
wins AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS w
         FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM worded WHERE len(ws) > 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM wins) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, i - coalesce(p, -8))) AS n_repeat
        FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM dup) GROUP BY rid),
feats AS (
  SELECT worded.* EXCLUDE (ws, ls, t),
    len(ws)::BIGINT AS f_n_words,
    length(array_to_string(ws, ''))::BIGINT AS f_word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS f_n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS f_n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS f_n_repeat_words,
    len(ls)::BIGINT AS f_n_lines,
    len(list_filter(ws, lambda w: w IN ({_STOPS})))::BIGINT AS f_n_stop,
    len(regexp_extract_all(t, '\p{{{{Lu}}}}'))::BIGINT AS f_n_capitals,
    len(list_filter(ws, lambda w: right(w, 1) = '!'))::BIGINT AS f_n_exclaimed
  FROM worded LEFT JOIN cov USING (rid)),
verdicts AS (
  SELECT *, (f_n_words < 20 OR 100 * f_n_repeat_words > 30 * f_n_words) AS f_base_failed,
    list_filter([
      CASE WHEN f_n_words > 0 AND (f_word_chars / f_n_words < 2.0 OR f_word_chars / f_n_words > 15.0) THEN 'mean_word_chars' END,
      CASE WHEN f_n_words > 0 AND f_n_symbols / f_n_words > 0.1 THEN 'symbol_ratio' END,
      CASE WHEN f_n_words > 0 AND f_n_stop / f_n_words < 0.02 THEN 'stop_word_ratio' END,
      CASE WHEN f_n_lines > 0 AND f_n_dup_lines / f_n_lines > 0.5 THEN 'dup_line_ratio' END,
      CASE WHEN f_word_chars > 0 AND f_n_capitals / f_word_chars > 0.4 THEN 'capital_ratio' END,
      CASE WHEN f_n_words > 0 AND f_n_exclaimed / f_n_words > 0.2 THEN 'exclaimed_ratio' END], lambda x: x IS NOT NULL) AS f_failed_rules
  FROM feats)
"""

OP6 = (
    "WITH "
    + QUALITY_FEATURES.format(docs="documents")
    + """SELECT doc_id, f_n_words AS n_words, f_word_chars AS word_chars, f_n_symbols AS n_symbols, f_n_dup_lines AS n_dup_lines,
  f_n_repeat_words AS n_repeat_words, f_base_failed AS base_failed, NOT f_base_failed AND len(f_failed_rules) = 0 AS kept,
  array_to_string(f_failed_rules, ',') AS failed_rules FROM verdicts"""
)

MIX = r"""
sized AS (SELECT *, coalesce(text, '') AS t FROM {docs}),
keyed AS (SELECT *, len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS m_size,
   len(regexp_extract_all(t, '[#*$%&|<>]')) AS m_sym,
   (('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(t)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS m_u FROM sized),
keys AS (SELECT *, -ln(m_u) / greatest((m_size::DOUBLE / (m_size + 20)) / (1.0 + 10.0 * m_sym::DOUBLE / greatest(m_size, 1)), 1e-6) AS m_key FROM keyed),
sources AS (SELECT source, sum(m_size)::BIGINT AS m_source_size FROM keys GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * m_source_size AS cap FROM sources),
levels AS (SELECT *, cap / w AS ratio,
   (1.5::DOUBLE * sum(m_source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed),
opened AS (SELECT *, (SELECT arg_min(lv, ratio) FROM levels WHERE lv < ratio) AS lambda_ FROM levels),
goals AS (SELECT source, m_source_size, CASE WHEN lambda_ IS NULL OR ratio <= lambda_ THEN cap ELSE w * lambda_ END AS m_target FROM opened),
placed AS (SELECT k.*, g.m_source_size, g.m_target,
   coalesce(sum(m_size) OVER (PARTITION BY k.source ORDER BY m_key, doc_id, m_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m_before,
   CASE WHEN g.m_source_size > 0 THEN floor(g.m_target / g.m_source_size) ELSE 0 END AS m_epochs
   FROM keys k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source),
mixed AS (SELECT *, least(m_size, greatest(0, round(m_target - m_epochs * m_source_size) - m_before))::BIGINT AS m_part FROM placed)
"""

OP8 = (
    "WITH "
    + MIX.format(docs="documents")
    + """SELECT doc_id, source, m_size AS size, m_source_size AS source_size, round(m_target, 6) AS target,
  (m_epochs * m_size + m_part)::BIGINT AS taken FROM mixed"""
)

OP4 = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(nullif(trim(role, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ''), 'unknown') AS name, coalesce(text, '') AS text,
    coalesce(floor(turn / 256), -1)::BIGINT AS block FROM conversations),
placed AS (SELECT *, floor((row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, name, text) - 1) / 256)::INT AS part FROM turns),
speakers AS (SELECT DISTINCT conv_id, name AS perspective FROM turns WHERE name <> 'system'),
seg AS (SELECT p.*, s.perspective, p.name = s.perspective AS target,
    CASE WHEN p.name = s.perspective THEN '<|assistant|>' || chr(10) WHEN p.name = 'system' THEN '<|system|>' || chr(10)
         ELSE '<|user name=' || replace(replace(p.name, '<|', '<\|'), '|>', '\|>') || '|>' || chr(10) END AS head,
    replace(replace(p.text, '<|', '<\|'), '|>', '\|>') || '<|end|>' || chr(10) AS body
    FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
place AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, block, part, perspective ORDER BY turn NULLS FIRST, name, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM seg)
SELECT conv_id, perspective, block, part, count(*)::BIGINT AS n_turns, sum(length(head) + length(body))::BIGINT AS n_chars,
  coalesce(sum(CASE WHEN target THEN length(body) END), 0)::BIGINT AS n_target_chars,
  string_agg(head || body, '' ORDER BY turn NULLS FIRST, name, text) AS text,
  coalesce(string_agg(CASE WHEN target THEN (p + length(head))::BIGINT || '-' || (p + length(head) + length(body))::BIGINT END, ',' ORDER BY p), '') AS mask
FROM place GROUP BY conv_id, perspective, block, part
"""


def op5_sql() -> str:
    from heronlake.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, need, template_words

    templates = ", ".join(f"({i}, '{label}', {template_words(t)!r}, {need(len(template_words(t)), THRESHOLD)})" for i, (label, t) in enumerate(TEMPLATES))
    hit = lambda p: " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(p.split()))
    places = " UNION ALL ".join(f"SELECT rid, i - 1 AS pos, '{label}' AS label FROM starts WHERE {hit(p)}" for p, label in PHRASES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '{word}') AS ws FROM docs),
starts AS (SELECT rid, ws, unnest(generate_series(1, len(ws))) AS i FROM worded WHERE len(ws) > 0),
places AS ({places}),
base AS (SELECT rid, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY rid),
templates(k, label, words, least) AS (VALUES {templates}),
blocks AS (SELECT rid, regexp_extract_all(unnest(string_split(regexp_replace(t, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1))), '{word}') AS b FROM docs),
met AS (SELECT rid, label, len(list_intersect(list_distinct(b), words)) / len(words) AS c FROM blocks, templates
        WHERE len(list_intersect(list_distinct(b), words)) >= least),
more AS (SELECT rid, list_distinct(list(label)) AS labels, max(c) AS c FROM met GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.first_word::BIGINT AS first_word, base.last_word::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  round(CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(more.c, 0.0::DOUBLE) END, 6) AS score
FROM worded LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""


OP10 = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
n AS (SELECT greatest(1, ceil(count(*) / 512))::BIGINT AS files FROM p),
r AS (SELECT page_id, u, ('0x' || substr(md5(coalesce(page_id::VARCHAR, 'null') || '|' || u), 1, 13))::BIGINT % files AS file,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:md5:' || md5(coalesce(page_id::VARCHAR, 'null') || '|' || u)
  || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
  || strlen(h) || chr(13) || chr(10) || chr(13) || chr(10) || h AS rec,
  ('0x' || substr(md5('rot|' || coalesce(page_id::VARCHAR, 'null')), 1, 13))::BIGINT % 100 AS rot FROM p, n),
l AS (SELECT page_id, u, file, strlen(rec)::BIGINT AS length, sha256(rec) AS hash, rot FROM r),
o AS (SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(length + 4) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM l WINDOW w AS (PARTITION BY file ORDER BY page_id, u, hash))
SELECT page_id, file, seq, off AS "offset", length, hash, CASE WHEN rot = 0 THEN 'corrupt' ELSE 'ok' END AS status FROM o
"""

JOIN = r"""
j_docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM {docs}),
j_words AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM j_docs),
j_sh AS (SELECT DISTINCT rid, array_to_string(ws[i:i+2], ' ') AS s FROM (SELECT rid, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS i FROM j_words WHERE len(ws) > 0)),
j_n AS (SELECT rid, count(*) AS n FROM j_sh GROUP BY rid),
j_df AS (SELECT s, count(*) AS df FROM j_sh GROUP BY s),
j_pre AS (SELECT rid, s, n FROM (SELECT rid, s, n, row_number() OVER (PARTITION BY rid ORDER BY df, s) AS r FROM j_sh JOIN j_df USING (s) JOIN j_n USING (rid))
          WHERE r <= n - ceil(0.9 * n) + 1),
j_cand AS (SELECT DISTINCT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb FROM j_pre a JOIN j_pre b USING (s) WHERE a.rid < b.rid AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
j_link AS (SELECT a, b FROM (SELECT c.a, c.b, c.na, c.nb, count(*) AS o FROM j_cand c JOIN j_sh x ON x.rid = c.a JOIN j_sh y ON y.rid = c.b AND y.s = x.s GROUP BY ALL)
           WHERE 100 * o >= 90 * (na + nb - o)),
j_both AS (SELECT a, b FROM j_link UNION SELECT b, a FROM j_link),
j_reach(a, b) AS (SELECT a, b FROM j_both UNION SELECT r.a, l.b FROM j_reach r JOIN j_both l ON r.b = l.a),
j_comp AS (SELECT a AS rid, min(d.doc_id) AS least_id FROM j_reach JOIN j_docs d ON d.rid = j_reach.b GROUP BY a),
joined AS (SELECT rid, doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id
           FROM j_docs LEFT JOIN j_n USING (rid) LEFT JOIN j_comp USING (rid))
"""

OP9 = "WITH RECURSIVE " + JOIN.format(docs="documents") + "SELECT doc_id, n_shingles, component_id FROM joined"

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
       WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least_id, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least_id, vec_id)) AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
