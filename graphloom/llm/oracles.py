"""SQL (DuckDB) that equals the registered queries of vector codes, URL filters and resampling."""

from __future__ import annotations

from .url_filter import LONG_SUFFIXES, RULES


def _lloyd(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain Lloyd rounds: every part against every entry."""
    steps = [
        f"""WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, label, t.part AS part, v[t.part * (len(v) // {parts}) + 1 : (t.part + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) t(part)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c
  FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})
)"""
    ]
    near = "SELECT p.vec_id, p.label, p.part, p.v, min({{'d': list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.entry}}) AS best FROM p JOIN b{r} b ON b.part = p.part GROUP BY ALL"
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED (
  {near.format(r=r)}
), x{r} AS (
  SELECT part, best.e AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{r}
), m{r} AS (
  SELECT part, entry, list(q ORDER BY place) AS c FROM (SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS q FROM x{r} GROUP BY ALL) GROUP BY ALL
), b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (part, entry)
)""")
    steps.append(f"""z AS MATERIALIZED (
  {near.format(r=rounds)}
), coded AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM z GROUP BY ALL
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books""")
    return ", ".join(steps)


def _urls(most_bad: float = 0.5, z: float = 1.645) -> str:
    rules = ", ".join(f"('{what}', '{text}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}')" for what, text in RULES)
    long = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
    k = "CASE WHEN {r} > 0 THEN least(1000, greatest(2, 1 / {r} - 1)) ELSE 1000 END"
    ratio = "(sum((bad - n * above) ** 2 - n * above * (1 - above)) / nullif(sum(n * (n - 1) * above * (1 - above)), 0))"
    fit = k.format(r=ratio)
    return rf"""
WITH u AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(what, rule, name, start) AS (VALUES {rules}), fit AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(what, length(rule)) AS said
  FROM u JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY ALL
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), seen AS (
  SELECT host, count(*) AS n, sum(bad) AS bad FROM u JOIN l ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?$', 1), '') AS BIGINT) GROUP BY host
), h0 AS (
  SELECT host, coalesce(n, 0)::DOUBLE AS n, coalesce(bad, 0)::DOUBLE AS bad, string_split(host, '.') AS w FROM (SELECT DISTINCT host FROM u WHERE host <> '') LEFT JOIN seen USING (host)
), h AS (
  SELECT host, n, bad, CASE WHEN array_to_string(w[-2:], '.') IN ({long}) THEN 2 ELSE 1 END AS width, array_to_string(w[-width:], '.') AS suffix, array_to_string(w[-width - 1:], '.') AS domain FROM h0
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM h) AS above FROM h GROUP BY suffix
), s1 AS (
  SELECT suffix, (k * above + bad) / (k + n) AS mean FROM s0, (SELECT {fit} AS k FROM s0)
), d0 AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS above FROM h JOIN s1 USING (suffix) GROUP BY domain, suffix
), d1 AS (
  SELECT domain, suffix, (k * above + bad) / (k + n) AS mean FROM d0, (SELECT {fit} AS k FROM d0)
), g0 AS (
  SELECT host, n, bad, mean AS above FROM h JOIN d1 USING (domain, suffix)
), g1 AS (
  SELECT host, (k * above + bad) / (k + n) AS mean, k + n AS a FROM g0, (SELECT {fit} AS k FROM g0)
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN mean - {z} * sqrt(mean * (1 - mean) / (a + 1)) > {most_bad} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (page_id, host, path) LEFT JOIN g1 USING (host)
"""


def _resampled(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), d AS (
  SELECT doc_id, {words} AS w FROM documents
), dw AS (
  SELECT doc_id, unnest(w) AS word FROM d
), tw AS (
  SELECT unnest({words}) AS word FROM benchmark
), bytes AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM tw))
), bucket AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} AS bucket FROM bytes, tab
), s AS (
  SELECT bucket, count(*) AS s FROM dw JOIN bucket USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM tw JOIN bucket USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {buckets})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {buckets})::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
), weight AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY doc_id
), score AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (doc_id)
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM score WHERE n_features >= {least_words}
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {percent} * count(*) // 100 FROM drawn) THEN rank END AS rank FROM score LEFT JOIN drawn USING (doc_id)
"""


ORACLE_SQL = {"op11_vector_code_compression": _lloyd(), "op12_url_filters": _urls(), "op13_importance_resampling": _resampled()}
