"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from tilewise.llm import license_scan
from tilewise.llm.mixing import MOST_EPOCHS
from tilewise.llm.quality_rules import BIT, POLICIES, RULES
from tilewise.llm.source_audit import LEAST_DOCS, PRIOR, TOP_TERMS, WHOLE
from tilewise.llm.url_filter import PARTS, RULES as URL_RULES
from tilewise.llm.warc import START

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The smallest node that each node of `links(a, b)` (both directions) reaches.
COMPONENTS = """reach AS (SELECT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.node = l.a),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""

WARC = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages),
d AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
q AS (SELECT *, [('0x' || substr(hex, 5 * k + 1, 5))::BIGINT FOR k IN range(0, 8)] AS v FROM d)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
 array_to_string(flatten([['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> 15) & 31)::INT + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> 10) & 31)::INT + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> 5) & 31)::INT + 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x & 31)::INT + 1]] FOR x IN v]), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to,
 strftime(TIMESTAMP '{START:%Y-%m-%d %H:%M:%S}' + page_id * INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS captured,
 url, CASE WHEN coalesce(url, '') = '' THEN '' ELSE concat(array_to_string(list_reverse(string_split(CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END, '.')), ','), ')', CASE WHEN path = '' THEN '/' ELSE path END,
 CASE WHEN query <> '' THEN concat('?', array_to_string(list_sort(string_split(query, '&')), '&')) ELSE '' END) END AS url_key FROM q
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, md5(concat('mix:', coalesce(doc_id::VARCHAR, 'null'))) AS key FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, source_size::DOUBLE / ((rank - 1) % 3 + 1) AS ratio FROM r),
l AS (SELECT *, sum(source_size) OVER () - {MOST_EPOCHS} * coalesce(sum(source_size) OVER o, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights FROM w WINDOW o AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, {MOST_EPOCHS} * source_size * weights <= weight * rest AS capped FROM l),
o AS (SELECT rest, weights FROM c WHERE NOT capped ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, source_size::BIGINT AS source_size, CASE WHEN capped THEN ({MOST_EPOCHS} * source_size)::DOUBLE ELSE ((SELECT rest FROM o) * weight)::DOUBLE / (SELECT weights FROM o) END AS target FROM c),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(target / t.source_size) ELSE 0 END::BIGINT AS epochs, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - start)))::BIGINT AS taken FROM e
"""

RULE_BITS = " + ".join(f"CASE WHEN {failed} THEN {BIT[name]} ELSE 0 END" for name, failed in RULES)
RULES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT r, k, array_to_string(w[k : k + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 6, 1))) AS k FROM d)),
rep AS (SELECT r, count(DISTINCT k + j) AS n FROM (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS c FROM win), range(0, 8) t(j) WHERE c > 1 GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_lines, coalesce(l.n - l.u, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (r) LEFT JOIN lines l USING (r)),
b AS (SELECT *, ({RULE_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {POLICIES["base"]} <> 0 AS base_failed, fail_bits & {POLICIES["v1"]} = 0 AS kept, fail_bits FROM b
"""

#: Brute force over all pairs: the lattice search finds them all on this table.
VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_inner_product(x.e, y.e) / (sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))) >= 0.98),
{COMPONENTS}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN roots ON node = vec_id
"""

SHINGLES = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
{COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN roots ON node = d.doc_id
"""

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 100 - 75 + (75 * len(w)::BIGINT * docs) // terms AS m FROM d, c WHERE len(w) > 0),
f AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
v AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, c GROUP BY t, docs),
q AS (SELECT b, item_id, t, count(*)::BIGINT AS k FROM (SELECT row_number() OVER () AS b, item_id, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT b, item_id, m.r, doc_id, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * m.m)))::BIGINT AS score FROM q JOIN v USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST) AS place FROM s WHERE score > 0)
SELECT item_id, place::INT AS rank, doc_id, score FROM o WHERE place <= 10
"""

SHARE = f"1 + ({WHOLE} * ({{}} + {PRIOR})::HUGEINT) // ({{}} + {PRIOR} * {{}})"
AUDIT = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[^\\x00-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::BIGINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
l AS (SELECT lang, count(*)::BIGINT AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, ({SHARE.format("coalesce(c.n, 0)", "g.total", "l.v")})::BIGINT AS p, ({SHARE.format("k.n", "l.total", "l.v")})::BIGINT AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM a)
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""

URLS = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path FROM pages),
u(verdict, h, b) AS (VALUES {", ".join(map(str, URL_RULES))}),
f AS (SELECT r, h, b, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h) + length(b) DESC, length(h) DESC) AS place FROM p JOIN u ON (host = h OR ends_with(host, concat('.', h))) AND starts_with(path, b))
SELECT page_id, host, path, concat(h, b) AS rule, verdict FROM p JOIN f USING (r) WHERE place = 1
UNION ALL SELECT page_id, host, path, NULL, 'allow' FROM p WHERE r NOT IN (SELECT r FROM f)
"""

SQL = {
    "op1_license_scan": license_scan.oracle(),
    "op2_warc": WARC,
    "op4_mixing": MIXING,
    "op6_quality_rules": RULES_SQL,
    "op7_embedding_dedup": VECTORS,
    "op10_ngram_join": SHINGLES,
    "op11_lexical_search": SEARCH,
    "op12_source_audit": AUDIT,
    "op13_url_filter": URLS,
}
