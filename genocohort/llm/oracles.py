"""DuckDB SQL for operators 2, 5, 8, 9, 12 and 13."""

from __future__ import annotations

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: Lines: exact repeats and lines within one edit of an earlier one; pairs are met by a shared half.
LINES = r"""
WITH occ AS (SELECT doc_id, CAST(k - 1 AS INT) AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL)),
seen AS (SELECT *, length(trim(line, ' ')) > 0 AS visible, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth, min(doc_id) OVER (PARTITION BY line) AS low FROM occ),
firsts AS (SELECT line, length(line) AS n, doc_id, pos FROM seen WHERE visible AND doc_id = low AND nth = 1),
halves AS (SELECT f.*, m.m, h.h, CASE WHEN h.h = 0 THEN substr(line, 1, CAST(floor(m.m / 2.0) AS INT)) ELSE right(line, m.m - CAST(floor(m.m / 2.0) AS INT)) END AS half FROM firsts f CROSS JOIN (SELECT unnest([0, 1]) AS d) x CROSS JOIN (SELECT unnest([0, 1]) AS h) h CROSS JOIN LATERAL (SELECT f.n + x.d AS m) m),
pairs AS (SELECT DISTINCT b.doc_id, b.pos, a.line AS x, b.line AS y FROM halves a JOIN halves b ON a.m = b.m AND a.h = b.h AND a.half = b.half AND (a.doc_id, a.pos) < (b.doc_id, b.pos) AND greatest(a.n, b.n) = a.m),
near AS (SELECT DISTINCT doc_id, pos FROM pairs WHERE CASE WHEN length(x) = length(y) THEN len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) <= 1
  WHEN length(x) = length(y) + 1 THEN len(list_filter(range(1, length(x) + 1), lambda i: substr(x, 1, i - 1) || substr(x, i + 1) = y)) > 0 WHEN length(y) = length(x) + 1 THEN len(list_filter(range(1, length(y) + 1), lambda i: substr(y, 1, i - 1) || substr(y, i + 1) = x)) > 0 ELSE false END),
judged AS (SELECT s.*, visible AND (nth > 1 OR doc_id > low) AS exact, n.doc_id IS NOT NULL AND NOT (visible AND (nth > 1 OR s.doc_id > low)) AS close FROM seen s LEFT JOIN near n USING (doc_id, pos))
SELECT d.doc_id, count(j.pos) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (close) AS n_near, count(*) FILTER (NOT exact AND NOT close) AS n_kept, sha256(coalesce(string_agg(j.line, chr(10) ORDER BY j.pos) FILTER (NOT exact AND NOT close), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id
"""

LEVELS = "\n".join(
    f"u{k} AS (SELECT source, node, unnest(range(1, quota + 1)) AS ball FROM t{k} WHERE quota > 0),"
    f"t{k + 1} AS (SELECT source, node, CAST(count(*) AS BIGINT) AS quota FROM (SELECT source, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY md5('mix-1|split{k}|' || CAST(node AS VARCHAR) || '|' || coalesce(source, chr(0)) || '|' || CAST(ball AS VARCHAR)), source, ball) <= ceil(count(*) OVER (PARTITION BY node) / 2) THEN 0 ELSE 1 END AS node FROM u{k}) GROUP BY source, node),"
    for k in range(4)
)

#: Targets by prefix sums over cap / weight; draws by md5 of the seed; four levels of halves drawn from urns; the pieces of
#: each row by the block edges in it.
MIX = rf"""
WITH rows_ AS (SELECT doc_id, source, len({WORDS.format("text")}) AS size, md5('mix-1|row|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, chr(0)) || '|' || md5(coalesce(text, ''))) AS key FROM documents),
sized AS (SELECT source, CAST(sum(coalesce(size, 0)) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w, 3 * source_size AS cap FROM sized),
ordered AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share FROM weighed),
targets AS (SELECT source, source_size, least(max(CASE WHEN rest / share * w <= cap THEN rest / share END) OVER () * w, CAST(cap AS DOUBLE)) AS target FROM ordered),
words_ AS (SELECT *, CAST(round(target) AS BIGINT) AS goal, CAST(ceil(greatest(1, sum(CAST(round(target) AS BIGINT)) OVER ()) / 4096) AS BIGINT) AS bw FROM targets),
quotas AS (SELECT *, CAST(ceil(goal / bw) AS BIGINT) AS quota FROM words_),
t0 AS (SELECT source, 0 AS node, quota FROM quotas WHERE quota > 0),
{LEVELS}
slots AS (SELECT source, node AS shard, unnest(range(upto - quota + 1, upto + 1)) AS k FROM (SELECT *, CAST(sum(quota) OVER (PARTITION BY source ORDER BY node) AS BIGINT) AS upto FROM t4)),
permuted AS (SELECT source, block, row_number() OVER (PARTITION BY source ORDER BY md5('mix-1|block|' || coalesce(source, chr(0)) || '|' || CAST(block AS VARCHAR)), block) AS k FROM (SELECT source, unnest(range(0, quota)) AS block FROM quotas WHERE quota > 0)),
dealt AS (SELECT p.source, p.block, s.shard FROM permuted p JOIN slots s ON s.source IS NOT DISTINCT FROM p.source AND s.k = p.k),
placed AS (SELECT row_number() OVER () AS row_id, r.doc_id, coalesce(r.size, 0) AS size, r.source, q.source_size, q.target, q.goal, q.bw, CAST(coalesce(sum(coalesce(r.size, 0)) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_ FROM rows_ r JOIN quotas q ON q.source IS NOT DISTINCT FROM r.source),
passes AS (SELECT row_id, source, bw, pass, pass * source_size + begin_ AS at_, least(size, goal - pass * source_size - begin_) AS words FROM placed CROSS JOIN (SELECT unnest([0, 1, 2]) AS pass)),
cut AS (SELECT *, unnest(range(at_ // bw, (at_ + words - 1) // bw + 1)) AS block FROM passes WHERE words > 0),
pieces AS (SELECT c.row_id, c.pass, c.block, d.shard, greatest(0, c.block * c.bw - c.at_) AS from_, least(c.words, (c.block + 1) * c.bw - c.at_) AS to_ FROM cut c JOIN dealt d ON d.source IS NOT DISTINCT FROM c.source AND d.block = c.block),
joined AS (SELECT row_id, CAST(sum(to_ - from_) AS BIGINT) AS taken, string_agg(concat_ws(':', pass, block, shard, from_, to_), ',' ORDER BY pass, block) AS pieces FROM pieces GROUP BY row_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(j.taken, 0) AS taken, coalesce(j.pieces, '') AS pieces FROM placed p LEFT JOIN joined j USING (row_id)
"""

SHINGLES = rf"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM words, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i) WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
ties AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM reach r JOIN ties e ON e.a = r.seen),
low AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept FROM documents d JOIN low l ON l.node = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
"""

VECTORS = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
ties AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, e.b FROM reach r JOIN ties e ON e.a = r.seen),
low AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
deg AS (SELECT a, count(*) AS n FROM ties GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept FROM v JOIN low l ON l.node = v.vec_id LEFT JOIN deg d ON d.a = v.vec_id
"""

#: The crc32 of a text's bytes, by a table of 256 entries.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t FROM (SELECT unnest(range(256)) AS n))"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
WAIT = "-ln((CAST('0x' || substr(md5(k || '|' || {0}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {1}"


def descent(name: str, tree: str) -> str:
    """Three levels of draws: the region with the least, in it the rack, in it the shard."""
    return f"""{name}r AS MATERIALIZED (SELECT k, arg_min(p, {WAIT.format("p", "w")}) AS r FROM keys CROSS JOIN (SELECT CAST(region AS VARCHAR) AS p, count(*) AS w FROM {tree} GROUP BY region) GROUP BY k),
{name}k AS MATERIALIZED (SELECT k, arg_min(p, {WAIT.format("p", "w")}) AS r FROM {name}r a JOIN (SELECT CAST(region AS VARCHAR) AS up, region || '/' || rack AS p, count(*) AS w FROM {tree} GROUP BY region, rack) b ON b.up = a.r GROUP BY k),
{name} AS MATERIALIZED (SELECT k, CAST(arg_min(shard, {WAIT.format("p", "1.0")}) AS INT) AS shard FROM {name}k a JOIN (SELECT region || '/' || rack AS up, region || '/' || rack || '/' || shard AS p, shard FROM {tree}) b ON b.up = a.r GROUP BY k)"""


TREE = rf"""
WITH {CRC_TABLE},
now AS (SELECT i // 8 AS region, i // 4 % 2 AS rack, i AS shard FROM range(24) t(i)), grown AS (SELECT * FROM now UNION ALL SELECT 3, 0, 24),
rows_ AS MATERIALIZED (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, strlen(coalesce(text, '')) + 8 AS size, {CRC.format("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
keys AS MATERIALIZED (SELECT DISTINCT k FROM rows_),
{descent("a", "now")},
{descent("b", "grown")}
SELECT doc_id, size, text_crc32, 'key' AS law, a.shard, row_number() OVER (PARTITION BY a.shard ORDER BY md5(k || ':' || text_crc32 || ':' || size)) - 1 AS slot, b.shard AS grown_shard FROM rows_ JOIN a USING (k) JOIN b USING (k)
"""

#: Nodes are prefixes of a key of one md5 a turn; each gives its share to every prefix of itself.
TRIE = rf"""
WITH {CRC_TABLE},
own AS MATERIALIZED (SELECT conv_id, list({{'m': md5(length(r) || ':' || r || x), 'b': strlen(x)}} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS turns FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
heights AS MATERIALIZED (SELECT conv_id, turns, {CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, crc),
rebuilt AS MATERIALIZED (SELECT a.conv_id, list_concat(coalesce(b.turns[1:h], []), a.turns[h + 1:]) AS turns FROM heights a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
keyed AS MATERIALIZED (SELECT conv_id, len(turns) AS n, coalesce(array_to_string(list_transform(turns, lambda t: t.m), ''), '') AS key, list_transform(turns, lambda t: t.b) AS bytes FROM rebuilt),
places AS MATERIALIZED (SELECT conv_id, n, d, substr(key, 1, CAST(32 * d AS INT)) AS key, CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS b FROM (SELECT *, unnest(range(n + 1)) AS d FROM keyed)),
nodes AS MATERIALIZED (SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(b) AS own, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ended FROM places GROUP BY key, d),
kids AS MATERIALIZED (SELECT substr(key, 1, CAST(32 * (depth - 1) AS INT)) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
shares AS (SELECT substr(key, 1, CAST(32 * unnest(range(depth + 1)) AS INT)) AS key, own, leaf FROM (SELECT n.*, CAST(k.n IS NULL AS INT) AS leaf FROM nodes n LEFT JOIN kids k USING (key))),
sums AS MATERIALIZED (SELECT key, sum(own) AS saved, sum(leaf) AS leaves FROM shares GROUP BY key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM nodes n JOIN sums s USING (key) LEFT JOIN kids k USING (key) LEFT JOIN nodes p ON n.depth > 0 AND p.key = substr(n.key, 1, CAST(32 * (n.depth - 1) AS INT))
"""

ORACLES = {"op2_line_dedup": LINES, "op5_source_mix": MIX, "op8_minhash_forest": SHINGLES, "op9_embedding_hnsw": VECTORS, "op12_hash_tree": TREE, "op13_conversation_trie": TRIE}
