"""DuckDB SQL of those operators that SQL can express.

Not expressed: op1 (keyed HMAC; tests hold it to an exact round trip), op2 (xxHash; plain winnowing), op4 (CRC-32; plain codes, curve and cut), op7 (a
fitted classifier; a plain decoder and held-out accuracy), op9 (a tokenizer; the library itself and a round trip of the files).
"""

from __future__ import annotations

from .mixing import BLOCK_WORDS, REPEAT, SEED, SHARDS, SHARE, WEIGHTS
from .secrets import BASE, RULES
from .substrings import LENGTH

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_weight = " ".join(f"WHEN {i} THEN {float(w)}::DOUBLE" for i, w in enumerate(WEIGHTS))

OP3 = rf"""WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}') AS h FROM documents),
s0 AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % {len(WEIGHTS)} {_weight} END AS w, {REPEAT} * source_size AS cap FROM s0),
s2 AS (SELECT *, ((sum(source_size) OVER ()) * {SHARE}::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM s1
  WINDOW b AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, first_value(CASE WHEN level * w <= cap THEN level END) OVER (ORDER BY CASE WHEN level * w <= cap THEN 0 ELSE 1 END, cap / w, k) AS lam FROM s2),
s4 AS (SELECT *, least(CAST(cap AS DOUBLE), coalesce(lam * w, 0)) AS target, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS m FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN target * m / source_size ELSE 0 END AS u FROM s4),
house AS (SELECT CAST(round(sum(u)) AS BIGINT) AS n FROM s5),
seats AS (SELECT k, seat, row_number() OVER (ORDER BY u / (2 * seat - 1) DESC, k, seat) AS rank FROM (SELECT k, u, unnest(generate_series(1, {REPEAT} * m)) AS seat FROM s5 WHERE u > 0)),
won AS (SELECT seats.*, (SELECT count(*) FROM generate_series(1, {SHARDS}) g(j) WHERE (n * j) // {SHARDS} < rank) AS shard FROM seats, house WHERE rank <= n),
quota AS (SELECT k, count(*) AS q FROM won GROUP BY k),
s AS (SELECT s5.*, coalesce(q, 0) AS q, coalesce(q, 0) // greatest(m, 1) AS passes, coalesce(q, 0) % greatest(m, 1) AS e, CAST('0x' || substr(md5(s5.k || ':{SEED}'), 1, 15) AS BIGINT) % greatest(m, 1) AS c FROM s5 LEFT JOIN quota USING (k)),
r AS (SELECT d.doc_id, d.size, s.*, coalesce(sum(d.size) OVER (PARTITION BY d.k ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d JOIN s USING (k)),
x AS (SELECT *, CAST(a // {BLOCK_WORDS} AS HUGEINT) AS i, CAST((a + size - 1) // {BLOCK_WORDS} AS HUGEINT) AS j, greatest(m, 1) AS mm FROM r),
y AS (SELECT *, (i * e + c) // mm AS c0, ((i + 1) * e + c) // mm AS c1, (j * e + c) // mm AS c2, ((j + 1) * e + c) // mm AS c3 FROM x),
z AS (SELECT *, CAST(passes * size + CASE WHEN size = 0 THEN 0 WHEN i = j THEN (c1 - c0) * size
  ELSE (c1 - c0) * ((i + 1) * {BLOCK_WORDS} - a) + {BLOCK_WORDS} * (c2 - c1) + (c3 - c2) * (a + size - j * {BLOCK_WORDS}) END AS BIGINT) AS taken, CASE WHEN q >= mm THEN i ELSE c0 END + 1 AS draw FROM y)
SELECT doc_id, size, source_size, target, taken, CASE WHEN size > 0 AND taken > 0 THEN CAST(coalesce(won.shard, {SHARDS}) AS INTEGER) END AS first_shard FROM z LEFT JOIN won ON won.k = z.k AND won.seat = z.draw"""

OP5 = rf"""WITH w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(t[i:i + n - 1], ' ') AS s FROM (SELECT item_id, t, least(13, len(t)) AS n, unnest(generate_series(1, len(t) - least(13, len(t)) + 1)) AS i FROM b WHERE len(t) > 0)),
g AS (SELECT doc_id, n, i, array_to_string(t[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, t, n, unnest(generate_series(1, len(t) - n + 1)) AS i FROM w, (SELECT DISTINCT n FROM p) WHERE len(t) >= n)),
h AS (SELECT doc_id, item_id, i, n FROM g JOIN p USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t)) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)"""

_quoted = lambda s: s.replace("'", "''")
_found = " UNION ALL ".join(
    f"""SELECT doc_id, '{r.kind}' AS kind, {n} AS ord, {r.least} AS least, string_split_regex(t, '{_quoted(r.pattern)}') AS b, regexp_extract_all(t, '{_quoted(r.pattern)}') AS m, regexp_extract_all(t, '{_quoted(r.pattern)}', {r.group}) AS v FROM d"""
    for n, r in enumerate(RULES)
)
_spans = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord)"
OP6 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_found}),
x AS (SELECT doc_id, kind, ord, least, i, v, m, list_sum(list_transform(b[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS s
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM f WHERE len(m) > 0)),
y AS (SELECT doc_id, kind, ord, CAST(s AS BIGINT) AS s, CAST(s + length(m[i]) AS BIGINT) AS e FROM x WHERE length(v[i]) >= least),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)}, coalesce({_spans} FILTER (WHERE ord < {len(BASE)}), '') AS base, {_spans} AS spans FROM y GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""

OP8 = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
o AS (SELECT doc_id, n, c, substr(h, 2000 * c + 1, 2000 + {2 * LENGTH}) AS o FROM (SELECT doc_id, h, n, unnest(generate_series(0, (n - {LENGTH}) // 1000)) AS c FROM d WHERE n >= {LENGTH})),
g AS (SELECT doc_id, 1000 * c + j AS i, substr(o, 2 * j + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, c, o, unnest(generate_series(0, least(999, n - {LENGTH} - 1000 * c))) AS j FROM o)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i FROM g JOIN f USING (s) WHERE first < doc_id),
k AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS head FROM c),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM k) GROUP BY 1, 2),
kept AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) AS a, r.a AS z FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY r.a)
  UNION ALL SELECT doc_id, coalesce(max(z), 0), n FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id, n),
t AS (SELECT doc_id, coalesce(string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)), '' ORDER BY a), '') AS left_ FROM kept JOIN d USING (doc_id) GROUP BY 1),
q AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(left_)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN q USING (doc_id)"""

OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS s FROM (SELECT doc_id, t, unnest(generate_series(1, greatest(1, len(t) - 4))) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM both_ UNION SELECT reach.doc_id, both_.b FROM reach JOIN both_ ON both_.a = reach.other),
m AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

ORACLES: dict[str, str] = {"op3_sainte_lague_mix": OP3, "op5_decontamination": OP5, "op6_secret_scan": OP6, "op8_suffix_dedup": OP8, "op10_minhash_dedup": OP10}
