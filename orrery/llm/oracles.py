"""DuckDB statements for the operators that SQL can express."""

OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    ELSE [array_to_string(w, ' ')] END)) AS g
  FROM w WHERE len(w) > 0),
t AS (SELECT DISTINCT doc_id, md5(array_to_string(g, '|')) AS k, g FROM g),
s AS (SELECT k, any_value(g) AS g, len(any_value(g)) AS n, count(*) AS c, min(doc_id) AS least FROM t GROUP BY 1),
x AS (SELECT k, n, unnest(g) AS gram FROM s),
p AS (
  SELECT a.k AS ka, b.k AS kb
  FROM x a JOIN x b ON a.gram = b.gram AND a.k <> b.k
  GROUP BY a.k, b.k, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.5 - 1e-9),
l AS (SELECT ka AS k, sum(c) AS links FROM p JOIN s ON s.k = kb GROUP BY 1),
i AS (
  SELECT t.doc_id, t.k, c - 1 + coalesce(links, 0) AS links
  FROM t JOIN s ON s.k = t.k LEFT JOIN l ON l.k = t.k WHERE c - 1 + coalesce(links, 0) > 0),
e AS (SELECT ka AS a, kb AS b FROM p UNION SELECT y.k, z.k FROM i y JOIN i z ON y.doc_id = z.doc_id AND y.k <> z.k),
r(k, o) AS (SELECT DISTINCT k, k FROM i UNION SELECT r.k, e.b FROM r JOIN e ON r.o = e.a),
m AS (SELECT r.k, min(s.least) AS class_id FROM r JOIN s ON s.k = r.o GROUP BY 1)
SELECT i.doc_id, min(m.class_id) AS class_id, sum(i.links)::BIGINT AS n_links FROM i JOIN m ON m.k = i.k GROUP BY 1
"""

OP2 = r"""
WITH a AS (
  SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|nav|article|section|header|footer|main|aside|table|tr|title|body|html|head)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), chr(10)) AS l
  FROM pages),
h AS (SELECT host, count(*) AS tot FROM a WHERE host <> '' GROUP BY 1),
c AS (
  SELECT host, line, count(*) AS n
  FROM (SELECT host, unnest(list_distinct(list_transform(l, lambda x: trim(x, ' ')))) AS line FROM a WHERE host <> '')
  WHERE line <> '' GROUP BY ALL),
bad AS (SELECT c.host, list(line) AS b FROM c JOIN h USING (host) WHERE n >= 2 AND n::DOUBLE / tot > 0.05 GROUP BY 1),
k AS (
  SELECT page_id, a.host, l, CASE WHEN b IS NULL THEN l ELSE list_filter(l, lambda x: trim(x, ' ') = '' OR NOT list_contains(b, trim(x, ' '))) END AS kept
  FROM a LEFT JOIN bad ON a.host = bad.host)
SELECT page_id, host, array_to_string(kept, chr(10)) AS text, (len(l) - len(kept))::BIGINT AS dropped_lines FROM k
"""


OP5 = r"""
WITH c AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
d AS (
  SELECT a.vec_id AS query_id, o.vec_id AS neighbor_id,
    list_sum(list_transform(list_zip(a.b, o.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS distance
  FROM c a JOIN c o ON a.vec_id <> o.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""


def _op4() -> str:
    dims = {"source": 0.8, "lang": 0.9, "topic": 1.0}
    ctes = [r"""
d AS (
  SELECT *, coalesce(source, '') AS s_, coalesce(lang, '') AS l_,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
      WHEN contains(lower(coalesce(text, '')), 'licens') OR contains(lower(coalesce(text, '')), 'rights reserved') THEN 'legal'
      WHEN contains(coalesce(text, ''), '@') THEN 'contact' ELSE 'prose' END AS topic,
    len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM documents),
c0 AS (SELECT s_ AS source, l_ AS lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS w FROM d WHERE n_tokens > 0 GROUP BY ALL)"""]
    last = "c0"
    for i, (dim, p) in enumerate(dims.items()):
        ctes.append(f"m{i} AS (SELECT *, sum(w) OVER (PARTITION BY {dim}) AS m_, sum(w) OVER () AS all_ FROM {last})")
        ctes.append(f"s{i} AS (SELECT *, pow(m_ / all_, {p}) AS s_ FROM m{i})")
        ctes.append(f"t{i} AS (SELECT * EXCLUDE (m_, all_, s_), s_ / sum(s_ * w / m_) OVER () * all_ AS t_{dim} FROM s{i})")
        last = f"t{i}"
    n = 0
    for _ in range(8):
        for dim in dims:
            ctes.append(f"r{n} AS (SELECT * REPLACE (w * t_{dim} / sum(w) OVER (PARTITION BY {dim}) AS w) FROM {last})")
            last, n = f"r{n}", n + 1
    return (
        "WITH " + ",\n".join(ctes) + f""",
p AS (SELECT source, lang, topic, (w / tokens) / max(w / tokens) OVER () AS p FROM {last})
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(p.p, 6) AS probability
FROM d JOIN p ON d.s_ = p.source AND d.l_ = p.lang AND d.topic = p.topic
WHERE n_tokens > 0 AND ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT / 4294967296.0 < p.p
"""
    )


OP4 = _op4()
