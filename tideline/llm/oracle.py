"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, md5('tideline-mix-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS drawn,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
    row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place
  FROM s
), f AS (
  SELECT min(place) AS place FROM o WHERE w * (total - capped) <= 3 * source_size * open_w
), t AS (
  SELECT o.source, o.source_size,
    CASE WHEN o.place < f.place THEN CAST(3 * o.source_size AS DOUBLE)
      ELSE CAST(o.w * (e.total - e.capped) AS DOUBLE) / CAST(e.open_w AS DOUBLE) END AS target
  FROM o, f JOIN o e ON e.place = f.place
), a AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS quota,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY drawn, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE
    size * (quota // source_size + CASE WHEN 2 * start + size < 2 * (quota % source_size) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM a
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[k:k + 4] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS k FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), r AS (
  SELECT x AS node, x AS root FROM e UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.root
), m AS (
  SELECT node, min(root) AS root FROM r GROUP BY node
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(m.root, w.doc_id) AS BIGINT) AS component_id,
  coalesce(m.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id
"""

OP5 = """
WITH v AS (
  SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), s AS (
  SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0
), f AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, docs
), c AS (
  SELECT i.item_id, d.r, d.doc_id,
    CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * len(d.terms) * s.docs) // s.total)))) AS BIGINT) AS score
  FROM i JOIN f ON f.term = i.term JOIN w ON w.term = i.term JOIN d ON d.r = f.r, s
  WHERE d.doc_id IS NOT NULL GROUP BY i.item_id, d.r, d.doc_id
), k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op4_minhash": OP4, "op5_topk": OP5, "op12_ranked": OP12}
