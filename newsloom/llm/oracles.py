"""DuckDB SQL of the operators that SQL can express: the same results by plain joins and recursion."""

from __future__ import annotations

from newsloom.llm import sharding

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Roots of the linked ids in l(a, b); ids without a link are added by the caller.
_ROOTS = """
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, root) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, r.root FROM reach r JOIN u ON u.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)"""

NGRAM_JOIN = rf"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
{_ROOTS}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(roots.root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN roots ON roots.node = d.doc_id
"""

VECTOR_JOIN = f"""
WITH RECURSIVE
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id < q.vec_id AND len(p.x) = len(q.x)
      WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
{_ROOTS},
k AS (SELECT a, count(*) AS n FROM u GROUP BY a)
SELECT e.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(roots.root, e.vec_id) AS component_id, coalesce(roots.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN roots ON roots.node = e.vec_id
"""


def _network(source: str, seed: int) -> str:
    """A pass of the network over ``source(g, x)``: g, x. One nested query for each round."""
    sql = f"(SELECT g, x >> narrow AS l, x & ((1::BIGINT << narrow) - 1) AS r, wide, narrow, n FROM {source}, cfg)"
    for i, (a, b, c) in enumerate(sharding.round_keys(seed)):
        width = "wide" if i % 2 == 0 else "narrow"
        sql = f"(SELECT g, l, r, (r * {a} + {b}) % {sharding.PRIME} AS v, wide, narrow, n FROM {sql})"
        sql = f"(SELECT g, r AS l, xor(l, (((v * v + {c}) % {sharding.PRIME}) >> 3) & ((1::BIGINT << {width}) - 1)) AS r, wide, narrow, n FROM {sql})"
    return f"SELECT g, (l << narrow) | r AS x FROM {sql}"


def _crc_table() -> str:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(str(i))
    return "[" + ", ".join(out) + "]::BIGINT[]"


def shard_sql(shards: int, seed: int) -> str:
    return f"""
WITH RECURSIVE
cfg AS (SELECT n, b - b // 2 AS wide, b // 2 AS narrow FROM (SELECT count(*) AS n, greatest(2, length(bin(count(*) - 1))) AS b FROM documents)),
hexed AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
crc AS (SELECT doc_id, CAST(len(h) + 16 AS BIGINT) AS size,
          xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(h, lambda y: CAST('0x' || y AS BIGINT))),
                          lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32
        FROM hexed, (SELECT {_crc_table()} AS t)),
num AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS g FROM crc),
walk(g, x) AS (
  {_network("(SELECT g, g AS x FROM num)", seed)}
  UNION ALL
  {_network("(SELECT w.g, w.x FROM walk w, cfg k WHERE w.x >= k.n)", seed)})
SELECT num.doc_id, num.size, num.text_crc32, 'rows' AS law, CAST(w.x % {shards} AS INTEGER) AS shard, w.x // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM num JOIN walk w USING (g), cfg WHERE w.x < cfg.n
"""

DIVERGENCE = rf"""
WITH
d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS nn FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
ln AS (SELECT lang, sum(n)::HUGEINT AS nn FROM c GROUP BY lang),
p AS (SELECT gn.lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 5) // (nn + 5 * v) AS p
      FROM gn JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT c.lang, term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 5) // (any_value(nn) + 5 * any_value(v)) AS q FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
         WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 50
"""


def trie_sql(family: int, heads: int) -> str:
    return f"""
WITH
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS p, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
      FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list(t ORDER BY p) AS s FROM o GROUP BY c),
h AS (SELECT c, s, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(c AS VARCHAR))), '..'), lambda y: CAST('0x' || y AS BIGINT))),
                          lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) % {heads} AS h
      FROM s, (SELECT {_crc_table()} AS t)),
b AS (SELECT h.c, list_concat(coalesce(s.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN s ON s.c = h.c - h.c % {family}),
x AS (SELECT c, d, len(s) AS n, sha256(to_json(s[1:d])) AS k, CASE WHEN d > 0 THEN sha256(to_json(s[1:d - 1])) END AS parent,
        CASE WHEN d > 0 THEN octet_length(encode(s[d].text)) ELSE 0 END AS size
      FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b)),
n AS (SELECT k, d, any_value(parent) AS parent, min(c) AS c, count(*) AS m, any_value(size) AS size, string_agg(CASE WHEN d = n THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS e FROM x GROUP BY k, d),
kids AS (SELECT parent AS k, count(*) AS kids FROM n GROUP BY parent),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (k)),
sub AS (SELECT x.k, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.m - 1) * f.size) AS saved FROM f JOIN x ON x.c = f.c AND x.d <= f.d GROUP BY x.k)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, p.c AS parent_conv_id, f.m AS n_convs, CAST(f.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.e, '')) AS ends_sha256
FROM f JOIN sub USING (k) LEFT JOIN n p ON p.k = f.parent
"""
