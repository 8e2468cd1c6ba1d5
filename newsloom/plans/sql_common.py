"""DuckDB text of the fixture views (FIXTURES.md section 3), shared by the oracles."""

# article view, articles with vectors (dv), fixture topics (asg) and sentiment (sen);
# the minimum topic size 8 and pair threshold 0.35 are those of tables.FIXTURE_PARAMS.
ARTICLES = """
art AS (
  SELECT doc_id,
         CASE WHEN doc_id % 50 = 7 THEN NULL
              ELSE trim(substring(split_part(text, chr(10), 1), 1, 80)) END AS title,
         text AS content,
         CAST(2015 + doc_id % 2 AS INTEGER) AS year,
         CAST(1 + (doc_id // 2) % 3 AS INTEGER) AS month
  FROM documents)"""

VECTORS = ARTICLES + """,
dv AS (
  SELECT a.*, e.label, CAST(e.embedding AS DOUBLE[]) AS v
  FROM art a JOIN embeddings e ON e.vec_id = a.doc_id)"""

TOPICS = VECTORS + """,
lab AS (SELECT year, month, label, count(*) AS n FROM dv GROUP BY year, month, label),
rk AS (SELECT year, month, label,
              CAST(row_number() OVER (PARTITION BY year, month ORDER BY n DESC, label) - 1 AS INTEGER) AS topic
       FROM lab WHERE n >= 8),
asg AS (SELECT dv.*, coalesce(rk.topic, -1) AS topic FROM dv LEFT JOIN rk USING (year, month, label)),
sen AS (
  SELECT asg.*,
         exp(4 * v[1]) / (exp(4 * v[1]) + exp(4 * v[2]) + exp(4 * v[3])) AS negative,
         exp(4 * v[2]) / (exp(4 * v[1]) + exp(4 * v[2]) + exp(4 * v[3])) AS neutral,
         exp(4 * v[3]) / (exp(4 * v[1]) + exp(4 * v[2]) + exp(4 * v[3])) AS positive
  FROM asg)"""


def with_(*parts: str) -> str:
    """WITH over CTE parts; the last part is the final SELECT."""
    return "WITH " + ",".join(parts[:-1]) + "\n" + parts[-1]


GLOBAL_EDGES = """
vv AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
gedges AS (SELECT a.vec_id AS id1, b.vec_id AS id2, list_cosine_similarity(a.v, b.v) AS weight
           FROM vv a JOIN vv b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.35)"""

MONTH_EDGES = """
medges AS (SELECT a.year, a.month, a.doc_id AS id1, b.doc_id AS id2, list_cosine_similarity(a.v, b.v) AS weight
           FROM dv a JOIN dv b ON a.year = b.year AND a.month = b.month AND a.doc_id < b.doc_id
           WHERE list_cosine_similarity(a.v, b.v) >= 0.35)"""

PROBS = """
cent AS (SELECT year, month, topic, list(m ORDER BY p) AS c FROM (
           SELECT year, month, topic, p, avg(x) AS m FROM (
             SELECT year, month, topic, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM sen WHERE topic <> -1)
           GROUP BY year, month, topic, p) GROUP BY year, month, topic),
cs AS (SELECT s.doc_id, list(list_cosine_similarity(s.v, c.c) ORDER BY c.topic) AS cs
       FROM sen s JOIN cent c USING (year, month) GROUP BY s.doc_id),
prb AS (SELECT sen.*, list_transform(cs.cs, lambda x: exp(x - list_max(cs.cs)) /
                 list_sum(list_transform(cs.cs, lambda y: exp(y - list_max(cs.cs))))) AS probs
        FROM sen JOIN cs USING (doc_id))"""
