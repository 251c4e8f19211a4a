"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import UPPER, WORD
from .licenses import PERCENT, PHRASES, TEMPLATES, split_words, template_sets

LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
WORDS = f"regexp_extract_all({LOWERED}, '{WORD}')"

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS a FROM p),
x AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s, a IS NOT NULL AND page_id IS DISTINCT FROM a AS again, a FROM f),
g AS (SELECT *, list_transform([1, 11, 21, 31], lambda i: CAST('0x' || substr(s, i, 10) AS BIGINT)) AS five FROM x)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(five, lambda v: array_to_string(
           list_transform(range(8), lambda j: substr('{BASE32}', CAST((v >> (35 - 5 * j)) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN a END AS refers_to
FROM g
"""

_SETS = template_sets(TEMPLATES)
_STEP = max(len(split_words(t)) for t in TEMPLATES.values())
_LISTS = ", ".join("('{}', [{}])".format(label, ", ".join(f"'{w}'" for w in sorted(s))) for label, s in _SETS.items())
_PHRASES = ", ".join("('{}', [{}])".format(label, ", ".join(f"'{w}'" for w in p.split(" "))) for p, label in PHRASES.items())

#: Brute force: every template against every block.
OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
ph AS (SELECT * FROM (VALUES {_PHRASES}) v(label, p)),
spots AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS i FROM d, ph WHERE len(w) >= len(p)),
base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b FROM spots GROUP BY r),
b AS (SELECT r, list_distinct(w[i + 1 : i + {2 * _STEP}]) AS s
      FROM (SELECT r, w, unnest(range(0, greatest(1, len(w) - {_STEP}), {_STEP})) AS i FROM d)),
t AS (SELECT * FROM (VALUES {_LISTS}) v(label, words)),
m AS (SELECT r, label, max(len(list_intersect(s, words)) / len(words)) AS c FROM b, t
      WHERE 100 * len(list_intersect(s, words)) >= {PERCENT} * len(words) GROUP BY r, label),
bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS v FROM (SELECT DISTINCT r, label FROM spots) GROUP BY r),
al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS v
       FROM (SELECT r, label FROM spots UNION SELECT r, label FROM m) GROUP BY r),
sc AS (SELECT r, max(c) AS c FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, a AS first_word, b AS last_word,
       coalesce(bl.v, '') AS base_labels, coalesce(al.v, '') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(sc.c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN sc USING (r)
"""

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
g AS (SELECT item, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM g),
sizes AS (SELECT DISTINCT m FROM grams),
p AS (SELECT r, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m),
q AS (SELECT r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM p),
h AS (SELECT r, i, q.m, item FROM q JOIN grams ON q.s = grams.s AND q.m = grams.m),
c AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + m)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 3), ' ') AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
x AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM x JOIN n p ON a = p.r JOIN n q ON b = q.r WHERE 100 * k >= 80 * (p.n + q.n - k)),
c AS (SELECT r, r AS o FROM d UNION SELECT c.r, e.b FROM c JOIN e ON c.o = e.a),
f AS (SELECT c.r, min(o.doc_id) AS component_id FROM c JOIN d o ON c.o = o.r GROUP BY c.r)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN f USING (r) LEFT JOIN n USING (r)
"""

OP9 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

_ROUND = """
a{i} AS MATERIALIZED (
  SELECT r, part, x, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT r, p.part, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM p JOIN c{i} USING (part))
  GROUP BY r, part, x)"""
_MOVED = """,
m{i} AS (SELECT part, e, list(v ORDER BY j) AS c
         FROM (SELECT part, e, j, CAST(floor(sum(x[j]) / count(*)) AS BIGINT) AS v
               FROM a{i}, range(1, 1025) t(j) WHERE j <= len(x) GROUP BY part, e, j) GROUP BY part, e),
c{n} AS MATERIALIZED (SELECT part, e, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (part, e)),"""

#: Brute force: every part against every entry, two rounds and the last assignment.
OP11 = f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, label,
                  list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM k, range(16) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 64),
{_ROUND.format(i=0)}{_MOVED.format(i=0, n=1)}
{_ROUND.format(i=1)}{_MOVED.format(i=1, n=2)}
{_ROUND.format(i=2)},
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM c2) AS codebooks_sha256
FROM k JOIN f USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1,
        "op2_license_scan": OP2,
        "op4_decontamination": OP4,
        "op6_minhash_near_dedup": OP6,
        "op9_exact_dedup": OP9,
        "op11_vector_codes": OP11,
    }
