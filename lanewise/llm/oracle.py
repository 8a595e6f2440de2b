"""DuckDB SQL of the operators that SQL can express; columns as the queries return them."""

#: Spans of a pattern's matches are not a SQL function, a tokenizer, dictionaries and a fit are not SQL: op5, op6, op7, op9 and op10 have none.
SQL: dict[str, str] = {}

SQL["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
  FROM d GROUP BY source),
w AS (SELECT *, (r % 3) + 1 AS w, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT max(level) FROM l)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM t),
c AS (SELECT *, CASE WHEN epochs < 3 THEN CAST(round(target - epochs * source_size) AS BIGINT) ELSE 0 END AS rest FROM b),
p AS (
  SELECT d.*, c.source_size, c.target, c.epochs, c.rest,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS before
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, CAST(size * epochs + greatest(least(rest - before, size), 0) AS BIGINT) AS taken FROM p
"""

SQL["op3_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE x.n * 10 >= y.n * 9 AND y.n * 10 >= x.n * 9
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM both_ways
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

SQL["op8_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS i FROM c),
a AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY i) AS turns,
         coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss,
         string_agg('### ' || replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') || ': '
                    || replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') || '</turn>' || chr(10), '' ORDER BY i) AS formatted
  FROM n GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(length(formatted) AS BIGINT) AS formatted_chars
FROM a
"""


def _quality() -> str:
    from .quality import RULES, STOP_WORDS

    stop = ", ".join("'" + w + "'" for w in STOP_WORDS)
    verdict = " OR ".join(f"(n_words >= {least} AND {metric} {op} {value})" for metric, op, value, least in RULES)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM w, unnest(generate_series(1, len(w) - 7)) AS u(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
cover AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (
  SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({stop}))) AS n_stop,
         length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters,
         len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]\s'))) AS n_bullets,
         len(list_filter(l, lambda x: regexp_matches(rtrim(x, ' '), '(\.\.\.|…)$'))) AS n_ellipses
  FROM l LEFT JOIN cover ON cover.doc_id = l.doc_id),
r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_line_ratio,
         CASE WHEN n_lines > 0 THEN n_ellipses / n_lines ELSE 0 END AS ellipsis_line_ratio,
         CASE WHEN word_chars > 0 THEN n_letters / word_chars ELSE 0 END AS alpha_ratio,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {verdict}) AS kept FROM r
"""


SQL["op4_quality"] = _quality()

SQL["op2_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
t AS (
  SELECT doc_id, pos, line,
         list_filter(regexp_split_to_array(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS k
  FROM l),
s AS (
  SELECT *, len(k) AS n, CAST(ceil((len(k) - 2) / 5.0) AS BIGINT) AS w, len(list_filter(k, lambda x: x <> '<*>')) AS c FROM t WHERE len(k) > 0),
leaves AS (
  SELECT doc_id, pos, CASE WHEN n >= 3 AND c * 2 >= n THEN 'whole ' || array_to_string(k, ' ') ELSE 'exact ' || line END AS leaf FROM s
  UNION ALL
  SELECT doc_id, pos, concat_ws(chr(1), n, k[1], k[2], o, CASE WHEN o <> 0 THEN array_to_string(k[3 : w + 2], ' ') ELSE '*' END,
         CASE WHEN o <> 1 THEN array_to_string(k[w + 3 : 2 * w + 2], ' ') ELSE '*' END, CASE WHEN o <> 2 THEN array_to_string(k[2 * w + 3 : 3 * w + 2], ' ') ELSE '*' END,
         CASE WHEN o <> 3 THEN array_to_string(k[3 * w + 3 : 4 * w + 2], ' ') ELSE '*' END, CASE WHEN o <> 4 THEN array_to_string(k[4 * w + 3 : 5 * w + 2], ' ') ELSE '*' END) AS leaf
  FROM s, unnest([0, 1, 2, 3, 4]) AS u(o) WHERE n >= 3 AND w * 4 <= n AND (c - w) * 2 >= n AND o * w + 2 < n),
f AS (SELECT leaf, min(doc_id) AS low FROM leaves GROUP BY leaf),
gone AS (SELECT DISTINCT leaves.doc_id, pos FROM leaves JOIN f ON f.leaf = leaves.leaf WHERE leaves.doc_id > f.low),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE kept.text END AS text
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

SQL["op7_embedding_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, least(d.vec_id, coalesce(m.low, d.vec_id)) AS component_id, d.vec_id <= coalesce(m.low, d.vec_id) AS kept
FROM embeddings d LEFT JOIN (SELECT a, count(*) AS n FROM both_ways GROUP BY a) n ON n.a = d.vec_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = d.vec_id
"""

SQL["op11_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to
FROM q
"""
