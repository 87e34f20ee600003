"""SQL for DuckDB that gives the rows of the queries, where SQL can express them."""

from __future__ import annotations

from pairworks.llm.secret_scan import KINDS

# The kinds again, in RE2's syntax and with letters of either case spelt out.
_PATTERNS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
    "user": (r"""([uU][sS][eE][rR]_?[nN][aA][mM][eE]|[uU][sS][eE][rR]|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][oO][uU][nN][tT])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9@+_.-]+)""", 2, 3),
    "blob": (r"[A-Za-z0-9+/]+", 0, 40),
    "endpoint": (r"""(https?|ftp|jdbc:[a-z]+|postgres(ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"''<>]+""", 0, 1),
    "userinfo": (r"""(https?|ftp|jdbc:[a-z]+|postgres(ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"''<>/@:]*:[^\x00-\x20"''<>/@]+@[^\x00-\x20"''<>]+""", 0, 1),
}


def _matches(kind: str) -> str:
    pattern, group, least = _PATTERNS[kind]
    holds = """ AND regexp_matches(v[i], '[0-9]') AND len(list_filter(string_split(v[i], '/'), lambda x: length(x) >= 12
                 AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]'))) > 0""" if kind == "blob" else ""
    return f"""
    SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS ord, s AS s, s + length(m[i]) AS e
    FROM (SELECT rid, m, v, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
                 + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
          FROM (SELECT rid, m, v, g, unnest(generate_series(1, len(m))) AS i
                FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v,
                             string_split_regex(t, '{pattern}') AS g FROM d))
          WHERE length(v[i]) >= {least}{holds})"""


SECRETS = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS MATERIALIZED ({" UNION ALL ".join(map(_matches, KINDS))}),
base AS (SELECT * FROM parts WHERE ord < 3),
-- Parts that overlap are no partners.
weak AS MATERIALIZED (SELECT * FROM parts p WHERE ord >= 3 AND NOT EXISTS (
    SELECT 1 FROM parts o WHERE o.rid = p.rid AND o.s < p.e AND p.s < o.e AND CASE p.kind
        WHEN 'blob' THEN o.ord < 3 OR o.kind = 'endpoint' WHEN 'user' THEN o.ord < 3 OR o.kind = 'blob' ELSE FALSE END)),
free AS MATERIALIZED (SELECT * FROM base p WHERE kind = 'assign' AND NOT EXISTS (
    SELECT 1 FROM parts o WHERE o.rid = p.rid AND o.s < p.e AND p.s < o.e AND o.kind = 'endpoint')),
linked AS (SELECT * FROM weak w WHERE kind = 'userinfo' OR EXISTS (
    SELECT 1 FROM (SELECT *, '' AS f FROM base UNION ALL SELECT *, '' FROM weak UNION ALL SELECT *, 'free' FROM free) o
    WHERE o.rid = w.rid AND o.s < w.e + 200 AND w.s < o.e + 200 AND CASE w.kind
        WHEN 'user' THEN o.kind IN ('assign', 'hex', 'blob') WHEN 'blob' THEN o.kind IN ('access', 'user', 'endpoint')
        ELSE o.f = 'free' OR o.kind = 'blob' END)),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS j
      FROM base GROUP BY rid),
b AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS j
      FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(a.j, '')) AS base_sha256, coalesce(b.j, '') AS spans
FROM d LEFT JOIN a USING (rid) LEFT JOIN b USING (rid)"""

# The words taken follow from the quota and each document's place in its source's shuffled order; the slots from the points
# of the sequence, the digits of a slot's number reversed.
MIX = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
-- The level per weight if all sources that fill up earlier are full.
f AS (SELECT a.source, 3.0 * a.source_size / a.weight AS ratio, (sum(b.source_size) FILTER (TRUE) - coalesce(sum(3 * b.source_size) FILTER (
                 3.0 * b.source_size / b.weight < 3.0 * a.source_size / a.weight), 0)) / CAST(sum(b.weight) - coalesce(
                 sum(b.weight) FILTER (3.0 * b.source_size / b.weight < 3.0 * a.source_size / a.weight), 0) AS DOUBLE) AS level
      FROM s a, s b GROUP BY a.source, a.source_size, a.weight),
l AS (SELECT arg_min(level, ratio) AS level FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source WHERE f.level * s.weight <= 3 * s.source_size),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * l.level) AS target FROM s, l),
o AS (SELECT doc_id, size, t.source_size, target, CAST(round(target) AS BIGINT) AS quota,
             coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY md5('mix:' || doc_id), doc_id, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
q AS (SELECT source, CAST(round(target) AS BIGINT) AS quota FROM t WHERE round(target) > 0),
h AS (SELECT source, quota, CAST(ceil(quota / 512.0) AS BIGINT) AS blocks,
             (sum(quota) OVER w - quota) / CAST(sum(quota) OVER () AS DOUBLE) AS lo, sum(quota) OVER w / CAST(sum(quota) OVER () AS DOUBLE) AS hi
      FROM q WINDOW w AS (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING)),
n AS (SELECT CAST(ceil(sum(quota) / 512.0) AS BIGINT) AS slots FROM q),
p AS (SELECT slot, list_sum(list_transform(range(0, 52), lambda i: CAST((slot >> i) & 1 AS DOUBLE) / (1::BIGINT << (i + 1)))) AS point
      FROM (SELECT unnest(range(0, slots)) AS slot FROM n)),
r AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS block, blocks FROM p JOIN h ON point >= lo AND point < hi),
g AS (SELECT h.source, blocks, count(r.slot) AS given FROM h LEFT JOIN (SELECT source, slot FROM r) r ON r.source IS NOT DISTINCT FROM h.source GROUP BY h.source, blocks),
k AS (SELECT source, block, slot FROM r WHERE block < blocks
      UNION ALL SELECT source, block, slots + block - given FROM (SELECT source, given, unnest(range(given, blocks)) AS block FROM g), n),
c AS (SELECT o.*, row_number() OVER () AS row FROM (SELECT o.*, d.source FROM o JOIN (SELECT doc_id, source FROM documents) d USING (doc_id)) o),
u AS (SELECT row, source, size, quota, round * source_size + begin_at AS start
      FROM (SELECT *, unnest(range(0, CAST((quota - 1 - begin_at) // source_size + 1 AS BIGINT))) AS round FROM c WHERE size > 0 AND quota > begin_at)),
y AS (SELECT row, source, unnest(range(CAST(start // 512 AS BIGINT), CAST(least((quota - 1) // 512, (start + size - 1) // 512) + 1 AS BIGINT))) AS block FROM u),
z AS (SELECT y.row, min(slot) AS first_slot, count(slot) AS n_slots FROM y JOIN k ON k.source IS NOT DISTINCT FROM y.source AND k.block = y.block GROUP BY y.row)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (quota // source_size)
            + greatest(0, least(size, quota % source_size - begin_at)) END AS BIGINT) AS taken, first_slot, coalesce(n_slots, 0) AS n_slots
FROM c LEFT JOIN z ON z.row = c.row"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""

TOP_K = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""

LINES = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS MATERIALIZED (
    SELECT rid, doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT rid, doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM d)),
k AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 2),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.first AS dropped FROM l LEFT JOIN k ON l.key = k.key),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
             string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped) AS kept FROM m GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN g USING (rid)"""

# DuckDB has no CRC-32: its table is worked out, then the digits of each id are gone through.
TRIE = """
WITH crc AS (SELECT list(list_reduce(list_prepend(CAST(n AS BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                 lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY n) AS t
             FROM range(256) r(n)),
o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT c, turn, length(x) AS n, md5(length(r) || ':' || r || x) AS id FROM o),
p AS MATERIALIZED (SELECT c, id, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, id) AS pos FROM w),
v AS MATERIALIZED (
    SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''),
               lambda s: CAST(ascii(s) AS BIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT c FROM p), crc),
b AS (SELECT v.c, p.pos, p.id, p.n FROM v JOIN p ON p.c = v.base WHERE p.pos <= v.h
      UNION ALL SELECT v.c, p.pos + 1000000, p.id, p.n FROM v JOIN p ON p.c = v.c WHERE p.pos > v.h),
s AS MATERIALIZED (SELECT v.c, coalesce(list(b.id ORDER BY b.pos) FILTER (b.id IS NOT NULL), CAST([] AS VARCHAR[])) AS ids,
                          list(b.n ORDER BY b.pos) FILTER (b.id IS NOT NULL) AS ns FROM v LEFT JOIN b ON b.c = v.c GROUP BY v.c),
e AS (SELECT c, k AS depth, list_slice(ids, 1, k) AS path, CASE WHEN k > 0 THEN ns[k] ELSE 0 END AS n, len(ids) = k AS last
      FROM (SELECT c, ids, ns, unnest(range(0, len(ids) + 1)) AS k FROM s)),
nodes AS MATERIALIZED (
    SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM e GROUP BY path, depth),
kids AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
up AS (SELECT list_slice(path, 1, k) AS path, (n_convs - 1) * n AS saved, leaf
       FROM (SELECT nodes.path, n_convs, n, kids.path IS NULL AS leaf, unnest(range(0, depth + 1)) AS k FROM nodes LEFT JOIN kids ON kids.path = nodes.path)),
subs AS (SELECT path, CAST(count(*) FILTER (leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY path)
SELECT nodes.conv_id, nodes.depth, above.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens, nodes.ends_sha256
FROM nodes JOIN subs ON subs.path = nodes.path LEFT JOIN kids ON kids.path = nodes.path
LEFT JOIN nodes above ON nodes.depth > 0 AND above.path = list_slice(nodes.path, 1, nodes.depth - 1)"""

MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
             CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1, n) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM o"""

ORACLES = {"op4_exact_topk": TOP_K, "op8_secrets": SECRETS, "op9_mix": MIX, "op10_warc": WARC, "op11_line_dedup": LINES,
           "op12_prefix_trie": TRIE, "op13_fill_middle": MIDDLE}
