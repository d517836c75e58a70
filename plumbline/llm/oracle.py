"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from .licences import TEMPLATES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role,
         '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS shown,
         length(role) AS n_role, role || chr(0) || text AS both
  FROM conversations),
p AS (SELECT DISTINCT (conv_id // 2) * 2 AS c FROM conversations),
m AS (
  SELECT p.c, coalesce(min(i) FILTER (WHERE x IS DISTINCT FROM y), max(i) + 1) AS n
  FROM p JOIN (SELECT coalesce(a.conv_id, b.conv_id - 1) AS c, coalesce(a.i, b.i) AS i, a.both AS x, b.both AS y
               FROM (SELECT * FROM t WHERE conv_id % 2 = 0) a
               FULL JOIN (SELECT * FROM t WHERE conv_id % 2 = 1) b ON b.conv_id = a.conv_id + 1 AND a.i = b.i) z ON z.c = p.c
  GROUP BY p.c),
s AS (
  SELECT m.c, t.conv_id, t.i, t.role, t.shown, t.n_role, t.i >= m.n AS late,
         sum(CASE WHEN t.i >= m.n THEN length(t.shown) ELSE 0 END) OVER (PARTITION BY t.conv_id ORDER BY t.i) AS ends
  FROM m JOIN t ON t.conv_id // 2 * 2 = m.c),
g AS (
  SELECT c, conv_id % 2 AS side,
         string_agg(shown, '' ORDER BY i) FILTER (WHERE late) AS answer,
         string_agg(shown, '' ORDER BY i) FILTER (WHERE NOT late) AS prompt,
         string_agg(CAST(ends - length(shown) + 4 + n_role + 1 AS BIGINT) || '-' || CAST(ends AS BIGINT), ',' ORDER BY i) FILTER (WHERE late AND role = 'assistant') AS spans
  FROM s GROUP BY c, conv_id)
SELECT CAST(m.c AS BIGINT) AS chosen_id, CAST(m.c + 1 AS BIGINT) AS rejected_id, CAST(m.n AS BIGINT) AS n_common,
       coalesce(a.prompt, '') AS prompt, coalesce(a.answer, '') AS chosen, coalesce(b.answer, '') AS rejected,
       coalesce(a.spans, '') AS chosen_spans, coalesce(b.spans, '') AS rejected_spans
FROM m LEFT JOIN g a ON a.c = m.c AND a.side = 0 LEFT JOIN g b ON b.c = m.c AND b.side = 1
"""

_ROWS = ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in TEMPLATES)
_GRAMS = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END"
_WORDS = r"[x FOR x IN regexp_split_to_array(replace(lower({0}), 'licence', 'license'), '[^\p{{L}}\p{{N}}]+') IF x <> '']"

OP3 = f"""
WITH tw AS (SELECT licence, template, {_WORDS.format('template')} AS w FROM (VALUES {_ROWS}) v(licence, template)),
t AS (SELECT licence, template, {_GRAMS} AS g FROM tw),
u AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE contains(text, chr(10))),
uw AS (SELECT doc_id, line, {_WORDS.format('x')} AS w FROM u),
ug AS (SELECT doc_id, line, {_GRAMS} AS g FROM uw),
d AS (
  SELECT doc_id, line, licence, 2.0::DOUBLE * len(list_intersect(ug.g, t.g)) / (len(ug.g) + len(t.g)) AS dice
  FROM ug JOIN t ON 2.0::DOUBLE * least(len(ug.g), len(t.g)) / (len(ug.g) + len(t.g)) >= 0.8::DOUBLE AND len(ug.g) > 0),
b AS (SELECT doc_id, line, max(dice) AS dice, arg_min(licence, struct_pack(d := -dice, l := licence)) AS licence FROM d WHERE dice >= 0.8::DOUBLE GROUP BY doc_id, line),
f AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS l, max(dice) AS m FROM b GROUP BY doc_id)
SELECT x.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(l, '') AS licences, round(coalesce(m, 0.0), 9)::DOUBLE AS best_dice
FROM (SELECT DISTINCT doc_id FROM documents) x LEFT JOIN f USING (doc_id)
"""

_PLAIN = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP7 = f"""
WITH i AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
v AS (SELECT item_id, least(len(w), 10) AS s, w, unnest(range(0, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, s, array_to_string(w[p + 1 : p + s], ' ') AS key FROM v),
d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
x AS (SELECT doc_id, s, w, unnest(range(0, len(w) - s + 1)) AS p FROM d, (SELECT DISTINCT s FROM k) z WHERE len(w) >= s),
h AS (SELECT doc_id, p, x.s, item_id FROM (SELECT doc_id, p, s, array_to_string(w[p + 1 : p + s], ' ') AS key FROM x) x JOIN k ON k.s = x.s AND k.key = x.key),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + s)) AS at FROM h) y GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(c, ',' ORDER BY c) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS c FROM h) y GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP8 = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(c.last <> k.doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_HEX = "strpos('0123456789ABCDEF', h[{0}]) - 1"
_BYTES = f"[16 * ({_HEX.format('2 * i - 1')}) + {_HEX.format('2 * i')} FOR i IN range(1, len(h) // 2 + 1)]"

OP12 = f"""
WITH z AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS z),
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS x FROM documents),
l AS (SELECT translate(x, '{UPPER}', '{LOWER}') AS w, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || translate(x, '{UPPER}', '{LOWER}')) AS h, count(*) AS c FROM r GROUP BY ALL),
y AS (SELECT w, c, xor(list_reduce(list_concat([4294967295], {_BYTES}), lambda a, b: xor(a // 256, z[xor(a, b) % 256 + 1])), 4294967295) AS h FROM l, z WHERE length(w) >= 7),
t AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM y),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM t WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (
  SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest),
g AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN g USING (word)),
s AS (SELECT f.*, (SELECT min(near) FROM p WHERE p.word = f.word AND p.n = f.form_n) AS form FROM f),
o AS (
  WITH RECURSIVE o AS (SELECT word, word AS head, 0 AS k FROM s UNION ALL SELECT o.word, s.form, k + 1 FROM o JOIN s ON s.word = o.head WHERE s.form IS NOT NULL)
  SELECT word, arg_max(head, k) AS root FROM o GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM s JOIN o USING (word)
"""

OP13 = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
c AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM w),
f AS (
  SELECT row_number() OVER () AS r, part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND l.toxic = 1) AS toxic
  FROM c),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM l a, l b, l c, l d, l e
  WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND a.x <> e.x AND b.x <> c.x AND b.x <> d.x AND b.x <> e.x AND c.x <> d.x AND c.x <> e.x AND d.x <> e.x),
s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
z AS (
  SELECT part, o, step, substr(o, step, 1) AS x, n, good, toxic, fails, contains(fails, substr(o, step, 1)) AS failing,
         length(translate(substr(o, 1, step - 1), fails, '')) < step - 1 AS gone
  FROM g, s),
y AS (
  SELECT part, o, step, x, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND failing), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = x), 0) AS unique_fails,
         coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND good), 0) AS good_lost, coalesce(sum(n) FILTER (WHERE NOT gone AND failing AND toxic), 0) AS toxic_lost
  FROM z GROUP BY part, o, step, x)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM y
"""

ORACLE = {"op2_chat": OP2, "op3_licences": OP3, "op7_decontaminate": OP7, "op8_line_dedup": OP8, "op12_spelling": OP12, "op13_filter_audit": OP13}
