"""DuckDB SQL for the operators that SQL can express, on whole tables."""

from __future__ import annotations

_SPACE = "[\\x20\\x09-\\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

CHAT = """WITH t AS (SELECT conv_id, list({'t': turn, 'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, turns, len(turns) AS n FROM t),
p AS (SELECT DISTINCT md5(CAST(list_slice(turns, 1, i) AS VARCHAR)) AS h, i FROM (SELECT turns, unnest(range(1, n)) AS i FROM k)),
f AS (SELECT min(conv_id) AS conv_id FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.i = k.n AND p.h = md5(CAST(k.turns AS VARCHAR))) GROUP BY CAST(turns AS VARCHAR))
SELECT conv_id, CAST(floor(turn / 256) AS BIGINT) AS part, count(*) AS n_turns, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn) AS text FROM conversations SEMI JOIN f USING (conv_id) GROUP BY ALL"""

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), b AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common, any_value(p.n) AS na, any_value(q.n) AS nb FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b WHERE 100 * common >= 80 * (na + nb - common)),
r AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.node WHERE r.least < l.b),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON node = doc_id"""

JACCARD_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN w WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), b AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS common, any_value(p.n) AS na, any_value(q.n) AS nb FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b WHERE 100 * common >= 90 * (na + nb - common)),
r AS (SELECT doc_id AS node, doc_id AS least FROM documents UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.node WHERE r.least < l.b),
c AS (SELECT node, min(least) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(s) AS n_shingles, component_id FROM s JOIN c ON node = doc_id"""

DECONTAMINATION = f"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_PLAIN} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, w[k:k + 12] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT len(g) AS n FROM g), d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
o AS (SELECT doc_id, k, n, item_id FROM (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, z WHERE len(w) >= n) q JOIN g ON g.g = q.w[k:k + n - 1]),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM o) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM o GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)"""

SUBSTRING_DEDUP = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM g JOIN f USING (h) WHERE doc_id > least),
p AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d SEMI JOIN p USING (doc_id)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM t ANTI JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256 FROM d LEFT JOIN p USING (doc_id) LEFT JOIN k USING (doc_id)"""

SOURCE_DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS m FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10), v AS (SELECT lang, count(*) AS v, sum(m) AS m FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT lang, source, term, coalesce(n, 0) AS n, k.m FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, f.n, CAST(1 + CAST(1000000000 AS HUGEINT) * (f.n + 2) // (sum(f.n) OVER (PARTITION BY lang, source) + 2 * v.v) AS HUGEINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (f.m + 2) // (v.m + 2 * v.v) AS HUGEINT) AS q FROM f JOIN v USING (lang)),
o AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x QUALIFY part = 'pair' OR rank <= 10"""

HARD_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM e a JOIN e r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


def quality(rules, base, stop_words) -> str:
    """The counts and the threshold table as SQL, from the same rules."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(stop_words)))
    within = lambda r: " AND ".join(f"({r.numerator}) {sign} CAST({float(x)!r} AS DOUBLE) * ({r.denominator})" for sign, x in ((">=", r.low), ("<=", r.high)) if x is not None)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2)),
a AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 3)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g) WHERE times > 1) GROUP BY 1),
c AS (SELECT doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_ellipsis_lines, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words FROM d LEFT JOIN a USING (doc_id)),
b AS (SELECT *, NOT ({" AND ".join(within(r) for r in base)}) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(within(r) for r in rules)} AS kept FROM b"""
