"""The registered queries of this package: each applies one operator to its whole table.

``QUERIES``: name -> (callable, SQL twin or None). Operators that SQL cannot express are held against
brute force, an exact round trip or held-out labels in the tests.
"""

from __future__ import annotations

from trackspark.llm import attribution, cgk, differencing, divergence, html_paths, ogg, packing, prefix_free, quality, secrets, token_groups, toxicity, vector_codes
from trackspark.llm.common import table


def op1(spark, sf_dir):
    return html_paths.extract_text(table(spark, sf_dir, "pages"))


def op2(spark, sf_dir):
    return ogg.media_digests(table(spark, sf_dir, "documents"))


def op3(spark, sf_dir):
    return attribution.count_tokens(table(spark, sf_dir, "documents"))


def op4(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5(spark, sf_dir):
    return differencing.shard_by_bytes(table(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8(spark, sf_dir):
    return cgk.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9(spark, sf_dir):
    return prefix_free.remove_repeats(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d)
), first AS (
  SELECT s, min(doc_id) AS f FROM w GROUP BY s
), c AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q
  FROM w JOIN first USING (s) WHERE f < doc_id
), r AS (
  SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM c
), spans AS (
  SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, k
), cuts AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM spans
  UNION ALL
  SELECT d.doc_id, d.n, d.n, coalesce(max(s.b), 0) FROM d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id, d.n
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a, z) AS hx FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(x.removed, 0)::BIGINT AS n_removed, coalesce(x.spans, 0)::BIGINT AS n_spans,
  sha256(unhex(kept.hx)) AS kept_sha256
FROM d JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id) x USING (doc_id)
"""


def op10(spark, sf_dir):
    return token_groups.near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), t AS (
  SELECT doc_id, unnest(sh) AS x FROM s
), links AS (
  SELECT p.a, p.b FROM (
    SELECT t.doc_id AS a, u.doc_id AS b, count(*) AS c FROM t JOIN t u ON t.x = u.x AND t.doc_id < u.doc_id GROUP BY 1, 2
  ) p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b
  WHERE 100 * p.c >= 90 * (len(sa.sh) + len(sb.sh) - p.c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM s
  UNION
  SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, (SELECT min(root) FROM reach r WHERE r.node = s.doc_id) AS component_id FROM s
"""

def op11(spark, sf_dir):
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """The rounds are written out: ``b<r>`` are the codebooks after r of them."""
    nearest = """
  SELECT r, part, v, min(struct_pack(d := d, k := k)) AS m FROM (
    SELECT c.r, c.part, c.v, b.k, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: (c.v[i] - b.c[i]) * (c.v[i] - b.c[i]))) AS d
    FROM cut c JOIN {book} b USING (part)
  ) GROUP BY r, part, v"""
    rounds = "".join(
        f"""
), s{r} AS MATERIALIZED (
  SELECT part, k, list(x ORDER BY i) AS c FROM (
    SELECT part, m.k AS k, i, CAST(floor(sum(v[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x
    FROM ({nearest.format(book=f"b{r - 1}")}), (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM cut))) AS i) GROUP BY ALL
  ) GROUP BY part, k
), b{r} AS MATERIALIZED (
  SELECT b.part, b.k, coalesce(s.c, b.c) AS c FROM b{r - 1} b LEFT JOIN s{r} s USING (part, k)"""
        for r in range(1, vector_codes.ROUNDS + 1)
    )
    last = f"b{vector_codes.ROUNDS}"
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT r, p AS part, q[p * (len(q) // 8) + 1 : (p + 1) * (len(q) // 8)] AS v FROM kept, (SELECT unnest(range(8)) AS p)
), b0 AS MATERIALIZED (
  SELECT part, r - 1 AS k, v AS c FROM cut WHERE r <= 16{rounds}
), done AS (
  SELECT r, string_agg(lower(printf('%02x', m.k)), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM ({nearest.format(book=last)}) GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, k)) AS h FROM {last}
), total AS (
  SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN done USING (r) GROUP BY label
)
SELECT vec_id, code, error, label_error, h AS codebooks_sha256
FROM kept JOIN done USING (r) JOIN total ON kept.label IS NOT DISTINCT FROM total.label, digest
"""


def op13(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), t AS (
  SELECT r, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) m USING (lang, source)
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.n + v.v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * (kept.n + 1)::HUGEINT) // (v.n + v.v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT s.lang, s.source, o.source AS item, sum(((s.p - o.p) * (s.p - o.p)) // o.p) AS value
    FROM p s JOIN p o ON s.lang = o.lang AND s.term = o.term AND s.source <> o.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {
    "op1_tag_path_text": (op1, None),
    "op2_ogg_media": (op2, None),
    "op3_token_attribution": (op3, None),
    "op4_subword_toxicity": (op4, None),
    "op5_differencing_shards": (op5, None),
    "op6_token_efficiency_secrets": (op6, None),
    "op7_cost_balanced_packing": (op7, None),
    "op8_cgk_decontamination": (op8, None),
    "op9_prefix_free_dedup": (op9, OP9_SQL),
    "op10_token_group_join": (op10, OP10_SQL),
    "op11_boosted_quality": (op11, None),
    "op12_grid_cell_codes": (op12, _op12_sql()),
    "op13_source_divergence": (op13, OP13_SQL),
}
