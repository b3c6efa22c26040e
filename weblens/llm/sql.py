"""DuckDB SQL of the queries that SQL can express."""

_WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), h AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, (unhex(sha1(payload))::BIT)::VARCHAR AS bits FROM p
), d AS (
  SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32),
      lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(5), lambda j: (2 ** (4 - j))::INTEGER * (substr(bits, i * 5 + j + 1, 1))::INTEGER))::INTEGER, 1)),
      'string_agg', '') AS payload_digest
  FROM h
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM f
"""

_VORONOI = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_NGRAM = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    ELSE list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM w
), g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS overlap
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT x, y FROM o WHERE 100 * overlap >= 80 * (nx + ny - overlap)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (
  SELECT doc_id, doc_id AS near FROM s
  UNION
  SELECT c.doc_id, e.y FROM c JOIN e ON c.near = e.x
)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT doc_id, min(near) AS component_id FROM c GROUP BY doc_id) m USING (doc_id)
"""


def _mixing() -> str:
    """The sampling written out, with a plain running sum instead of cells."""
    closing = """
, best{n} AS (
  SELECT source, min(struct_pack(off := abs(words - (rest - taken - closed)), key := key, gap := rest - taken - closed, words := words)) AS b
  FROM open{p} GROUP BY source
), open{n} AS (
  SELECT o.* EXCLUDE (closed, picked), closed + coalesce(u.b.words, 0) AS closed,
    picked OR (u.b IS NOT NULL AND o.key = u.b.key) AS picked
  FROM all{p} o LEFT JOIN (SELECT * FROM best{n} WHERE b.off < b.gap) u ON o.source IS NOT DISTINCT FROM u.source
)"""
    rounds = "".join(
        closing.format(n=n, p=n - 1).replace(f"open{n} AS", f"all{n} AS") + f"\n, open{n} AS (SELECT * FROM all{n} WHERE NOT picked)"
        for n in (1, 2)
    )
    return rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('mix-1|' || coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5)
      / 4503599627370496.0 AS u
  FROM documents
), x AS (
  SELECT *, (u / (1.0 - u)) / (CASE WHEN size >= 1000 THEN 2.0 WHEN size >= 100 THEN 1.5 ELSE 1.0 END) AS odds FROM d
), sz AS (SELECT source, sum(size)::BIGINT AS source_size FROM x GROUP BY source),
rk AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rnk, (source_size * 3)::DOUBLE AS ceiling FROM sz
), wt AS (SELECT *, ([5.0, 2.0, 1.0])[(rnk % 3 + 1)::INTEGER]::DOUBLE AS weight FROM rk),
lv AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ceiling / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM wt
), st AS (SELECT *, level * weight >= ceiling AS stopped FROM lv),
common AS (SELECT arg_min(level, struct_pack(a := ceiling / weight, b := rnk)) AS level FROM st WHERE NOT stopped),
tg AS (
  SELECT source, source_size, CASE WHEN stopped THEN ceiling ELSE (SELECT level FROM common) * weight END AS target FROM st
), pl AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM tg
), pr AS (
  SELECT *, target - copies * source_size AS rest,
    CASE WHEN source_size > 0 THEN (target - copies * source_size) / source_size ELSE 0.0 END AS inclusion FROM pl
), k AS (
  SELECT x.source, odds / (inclusion / (1.0 - inclusion)) AS key, rest, sum(size)::BIGINT AS words
  FROM x JOIN pr ON x.source IS NOT DISTINCT FROM pr.source WHERE inclusion > 0 AND inclusion < 1 GROUP BY ALL
), rn AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key) AS until FROM k),
cut AS (SELECT source, min(key) AS next_key, min(until - words)::BIGINT AS taken FROM rn WHERE until > rest GROUP BY source),
all0 AS (
  SELECT k.*, cut.next_key, cut.taken, 0::BIGINT AS closed, false AS picked FROM k JOIN cut ON k.source IS NOT DISTINCT FROM cut.source
  WHERE key >= next_key
), open0 AS (SELECT * FROM all0){rounds}
, ex AS (SELECT source, key FROM all2 WHERE picked)
SELECT doc_id, size, pr.source_size, target,
  size * least(3, copies + CASE WHEN inclusion > 0 AND inclusion < 1 AND (
    cut.next_key IS NULL OR odds / (inclusion / (1.0 - inclusion)) < cut.next_key OR ex.key IS NOT NULL) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM x JOIN pr ON x.source IS NOT DISTINCT FROM pr.source
LEFT JOIN cut ON x.source IS NOT DISTINCT FROM cut.source
LEFT JOIN ex ON x.source IS NOT DISTINCT FROM ex.source AND inclusion > 0 AND inclusion < 1 AND odds / (inclusion / (1.0 - inclusion)) = ex.key
"""


_MINING = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


def _clustering() -> str:
    """Three rounds written out, with plain distances instead of tables."""
    parts = ["""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY key, q) - 1)::INTEGER AS c, q
  FROM (SELECT q, sha256('1:' || vec_id) AS key FROM v ORDER BY key NULLS LAST, q LIMIT 16)
)"""]
    for n in range(4):
        parts.append(f"""
, a{n} AS MATERIALIZED (
  SELECT i, min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda j: (v.q[j] - c{n}.q[j]) * (v.q[j] - c{n}.q[j])))::BIGINT, c := c)) AS b
  FROM v CROSS JOIN c{n} GROUP BY i
)""")
        if n < 3:
            parts.append(f"""
, m{n} AS (
  SELECT c, list(mean ORDER BY j) AS q FROM (
    SELECT a{n}.b.c AS c, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean
    FROM a{n} JOIN (SELECT i, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM v) USING (i) GROUP BY ALL
  ) GROUP BY c
), c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.q, c{n}.q) AS q FROM c{n} LEFT JOIN m{n} USING (c))""")
    return "".join(parts) + """
SELECT vec_id, a3.b.c AS cluster, a3.b.d AS distance,
  (sum(a3.b.d) OVER (PARTITION BY a3.b.c))::BIGINT AS cluster_inertia, (sum(a3.b.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM v JOIN a3 USING (i) JOIN c3 ON c3.c = a3.b.c
"""


ORACLES: dict[str, str] = {
    "op1_warc_segments": _WARC,
    "op3_pareto_mixing": _mixing(),
    "op5_ngram_join": _NGRAM,
    "op6_voronoi_join": _VORONOI,
    "op11_lookup_clustering": _clustering(),
    "op13_coordinate_mining": _MINING,
}
