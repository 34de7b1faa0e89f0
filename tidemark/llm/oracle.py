"""DuckDB SQL for the operators' queries, written from their contracts.

op2 is stated as a recurrence over all numbers of shards and all borders, not as a search.
op4 (a fitted classifier) and op10 (a tokenizer) have none; tests/llm holds them against
brute-force versions.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op1_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
f AS (SELECT *, sum(cap) OVER o - cap AS caps, sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w WINDOW o AS (ORDER BY cap / weight, source)),
g AS (SELECT *, cap * open <= (budget - caps) * weight AS is_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * ((budget - sum(CASE WHEN is_full THEN cap ELSE 0.0 END) OVER ()) / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ()) END AS target,
  ('0x' || substr(md5('{7}|' || coalesce('s' || source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off FROM g),
r AS (SELECT d.*, t.source_size, t.target, t.off, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) - 1 AS i FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM (SELECT *, (floor((i + 1) * rate + off) - floor(i * rate + off))::BIGINT AS copies FROM r)"""

_STEPS = ",\n".join(f"f{k} AS (SELECT b.e, min(greatest(a.f, b.e - a.e)) AS f FROM f{k - 1} a JOIN ends b ON a.e <= b.e GROUP BY 1)" for k in range(2, 17))
SQL["op2_sharding"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(text) AS grp, text, hex(encode(text)) AS h FROM documents),
crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
crc AS (SELECT text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM (SELECT DISTINCT text, h FROM d WHERE text IS NOT NULL), crc_table),
g AS (SELECT grp, sum(size) AS weight FROM d GROUP BY 1),
o AS (SELECT grp, weight, sum(weight) OVER (ORDER BY weight DESC, grp) AS e FROM g),
ends AS (SELECT e::BIGINT AS e FROM o),
f1 AS (SELECT e, e AS f FROM ends),
{_STEPS},
cap AS (SELECT f AS capacity FROM f16 ORDER BY e DESC LIMIT 1),
cuts AS (SELECT 0 AS k, 0::BIGINT AS cut UNION ALL SELECT k + 1, (SELECT max(e) FROM ends WHERE e <= cut + capacity) FROM cuts, cap WHERE k < 16),
p AS (SELECT o.grp, (SELECT count(DISTINCT cut) FROM cuts WHERE cut > 0 AND cut < o.e)::INTEGER AS shard, weight FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY weight DESC, d.grp, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN p ON d.grp IS NOT DISTINCT FROM p.grp LEFT JOIN crc ON crc.text = d.text"""

SQL["op3_recompression"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i : i + 34], ' ') END AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
m AS (SELECT doc_id, i, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM s),
g AS (SELECT p.*, bool_or(again) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM p JOIN m USING (doc_id, i)),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_ESCAPED = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"
SQL["op5_chatformat"] = rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) x(i))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length({_ESCAPED.format("text")}) + 10 + 1)::BIGINT AS formatted_chars
FROM r GROUP BY 1"""

_SCORE = "CASE c.rule WHEN 'symbol_share' THEN symbol_share WHEN 'upper_share' THEN upper_share WHEN 'dup_line_share' THEN dup_line_share ELSE pipe_share END"
_THOUSANDTHS = "CASE WHEN {1} > 0 THEN least(2000, 1000 * {0} // {1}) ELSE 0 END AS {2}"
# 5 % of good documents at most, shared by 4 rules; 5 % for all tests: 4 rules x 8 candidates x (languages and one pool).
SQL["op6_quality"] = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
m AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM m) GROUP BY 1),
b AS (SELECT d.doc_id, d.lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(regexp_extract_all(text, '\|')) AS n_pipes, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_THOUSANDTHS.format("n_symbols", "n_words", "symbol_share")}, {_THOUSANDTHS.format("n_upper", "word_chars", "upper_share")},
  {_THOUSANDTHS.format("n_dup_lines", "n_lines", "dup_line_share")}, {_THOUSANDTHS.format("n_pipes", "n_words", "pipe_share")} FROM b),
g AS (SELECT doc_id, min(quality) >= 1 AS good, substr(md5(doc_id::VARCHAR), 1, 1) >= '8' AS held FROM labels WHERE quality IS NOT NULL GROUP BY 1),
k AS (SELECT f.*, good, held FROM f JOIN g USING (doc_id) WHERE NOT base_failed),
p AS (SELECT rule, score FROM (SELECT unnest(['symbol_share', 'upper_share', 'dup_line_share', 'pipe_share']) AS rule, unnest([symbol_share, upper_share, dup_line_share, pipe_share]) AS score FROM k WHERE NOT held AND NOT good) WHERE score > 0),
cuts AS (SELECT DISTINCT rule, score AS cut FROM (SELECT rule, score, row_number() OVER (PARTITION BY rule ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY rule) AS n FROM p) WHERE i = 0 OR i * 8 // n > (i - 1) * 8 // n),
langs AS (SELECT lang, count(*) FILTER (held AND good) AS n FROM k GROUP BY 1),
lv AS (SELECT 0.05::DOUBLE / ((count(*) + 1) * 4 * 8) AS level FROM langs),
st AS (SELECT lang, n >= ceil(ln(level) / ln(1 - 0.0125::DOUBLE)) AS own FROM langs, lv),
c AS (SELECT own, CASE WHEN own THEN k.lang END AS stratum, c.rule, c.cut, count(*) FILTER (good) AS n, count(*) FILTER (good AND {_SCORE} >= c.cut) AS k, count(*) FILTER (NOT good AND {_SCORE} >= c.cut) AS bad
  FROM k JOIN st ON k.lang IS NOT DISTINCT FROM st.lang, cuts c WHERE held GROUP BY 1, 2, 3, 4),
t AS (SELECT *, CASE WHEN k >= n * 0.0125::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125::DOUBLE) + (n - i) * ln(1 - 0.0125::DOUBLE)))) END AS tail FROM c),
best AS (SELECT own, stratum, rule, arg_max(cut, (bad - 10 * k) * 10000 + cut) AS cut FROM t, lv WHERE tail <= level AND bad - 10 * k > 0 GROUP BY 1, 2, 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR EXISTS (SELECT 1 FROM st JOIN best c ON st.own = c.own AND c.stratum IS NOT DISTINCT FROM CASE WHEN st.own THEN st.lang END WHERE st.lang IS NOT DISTINCT FROM f.lang AND {_SCORE} >= c.cut)) AS kept FROM f"""

SQL["op7_suffixdedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range(0, n)) AS i, h FROM d WHERE n > 0),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN i + 50 <= n THEN md5(substr(h, 2 * i + 1, 100)) END AS win FROM p),
m AS (SELECT doc_id, i, b, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS later FROM w),
g AS (SELECT doc_id, i, b, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY 1)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op8_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
t AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
x AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + 9], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM t WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM x),
s AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), z WHERE i + size - 1 <= len(w)),
h AS (SELECT s.doc_id, s.i, s.size, x.item FROM s JOIN x ON s.size = x.size AND s.win = x.win),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

_LOWWORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
SQL["op9_jaccard"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWWORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u AS doc_id, min(v) AS least_id FROM r GROUP BY 1) m USING (doc_id)"""

_CRC = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t)"""
_CRC_OF = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
# Near words by equal remainders: a word with one code point left out is another word, or two words leave out different ones at the same place.
SQL["op11_variants"] = rf"""
WITH RECURSIVE {_CRC},
o AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
p AS (SELECT doc_id, run, count(*) AS m FROM o GROUP BY 1, 2),
h AS (SELECT p.*, {_CRC_OF.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM p, crc_table),
s AS (SELECT CASE WHEN h % 97 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 : length(run)] ELSE run END AS word, m FROM h),
w AS (SELECT word, sum(m)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY 1 HAVING sum(m) >= 3),
x AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 : length(word)] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (SELECT DISTINCT a.word, b.word AS near FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word FROM x JOIN w ON x.rest = w.word UNION SELECT w.word, x.word FROM x JOIN w ON x.rest = w.word),
g AS (SELECT e.word, count(*) AS n_near, min({{'n': -w.n, 'word': w.word}}) AS best FROM e JOIN w ON w.word = e.near GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 2 * w.n THEN best.word END AS form, CASE WHEN -best.n >= 2 * w.n THEN -best.n END AS form_n FROM w LEFT JOIN g USING (word)),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN r USING (word)"""

SQL["op12_hardneg"] = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER o)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER o <= 5"""
