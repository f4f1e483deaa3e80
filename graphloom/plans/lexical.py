"""Registered queries of trigram search and of names in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import parsing as P
from ..operators import entities as N
from ..operators import trigram as G
from ..sources import tables as T
from .catalog import query


@query(
    """WITH nm AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS t FROM part), qs AS (SELECT DISTINCT substr(p_name, 2) AS query, trim(regexp_replace(lower(substr(p_name, 2)), '[^a-z0-9]+', ' ', 'g')) AS q FROM part WHERE p_partkey % 20 = 0),
g AS (SELECT x, flatten(list_transform(string_split(x, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))) AS run FROM (SELECT DISTINCT t AS x FROM nm UNION SELECT DISTINCT q FROM qs)),
pr AS (SELECT a.x AS q, b.x AS t, list_distinct(a.run) AS qg, b.run AS run FROM g a, g b WHERE a.x IN (SELECT q FROM qs) AND b.x IN (SELECT t FROM nm)),
sc AS (SELECT q, t, len(list_intersect(qg, list_distinct(run)))::DOUBLE / (len(qg) + len(list_distinct(run)) - len(list_intersect(qg, list_distinct(run)))) AS s, list_max(list_transform(range(1, len(run) + 1), lambda i: list_max(list_transform(range(i, len(run) + 1), lambda j: len(list_intersect(qg, list_distinct(run[i:j])))::DOUBLE / (len(qg) + len(list_distinct(run[i:j])) - len(list_intersect(qg, list_distinct(run[i:j])))))))) AS w FROM pr),
r AS (SELECT query, id, round(s, 6) AS similarity, round(w, 6) AS word_similarity, greatest(round(s, 6), round(w, 6)) AS score FROM sc JOIN nm USING (t) JOIN qs USING (q) WHERE round(s, 6) >= 0.3 OR round(w, 6) >= 0.6) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM r QUALIFY rank <= 30"""
)
def word_similarity_search(spark, d):
    """Names without their first letter, from every part whose id is divisible by 20, against all names."""
    p = T.read(spark, d, "part")
    queries = p.where("p_partkey % 20 = 0").select(F.expr("substr(p_name, 2)").alias("query")).distinct()
    return G.similar_words(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), queries)


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL), nm AS (SELECT doc_id AS id, w[1:2] AS n FROM w WHERE doc_id % 20 = 0 AND len(w) >= 2 UNION ALL SELECT doc_id, w[1:4] FROM w WHERE doc_id % 20 = 0 AND len(w) >= 4), di AS (SELECT array_to_string(n, ' ') AS name, len(n) AS size, min(id) AS id, count(DISTINCT id) AS n_ids FROM nm GROUP BY ALL),
p AS (SELECT doc_id, i AS pos, w[i:i + 1] AS a, w[i:i + 3] AS b FROM w, range(1, len(w) + 1) r(i)), f AS (SELECT doc_id AS key, pos, size, name, id, n_ids FROM p JOIN di ON size = 2 AND name = array_to_string(a, ' ') UNION ALL SELECT doc_id, pos, size, name, id, n_ids FROM p JOIN di ON size = 4 AND len(b) = 4 AND name = array_to_string(b, ' ')),
k AS (SELECT *, max(pos + size) OVER (PARTITION BY key ORDER BY pos, size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f) SELECT key, pos::INT AS "at", size::INT AS size, name, CASE WHEN n_ids = 1 THEN id END AS id, n_ids FROM k WHERE reach IS NULL OR reach < pos + size"""
)
def entity_mentions(spark, d):
    """The first two and the first four words of documents whose id is divisible by 20 name them; looked for in all documents."""
    docs = T.read(spark, d, "documents")
    w = N.words_of(F.col("text"))
    named = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("id"), w.alias("w"))
    names = named.select("id", F.explode(F.array(F.struct(F.lit(2).alias("k")), F.struct(F.lit(4).alias("k")))).alias("k"), "w").where(F.size("w") >= F.col("k.k")).select("id", F.array_join(F.slice("w", F.lit(1), F.col("k.k")), " ").alias("name"))
    return N.mentions(docs.select(F.col("doc_id").alias("key"), "text"), names)


SQL_PLAIN = "translate(nfc_normalize(text), '{}', '{}')".format(C.QUOTES, C.STRAIGHT.replace("'", "''"))


@query("SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[^0-9a-z+]+', ' ', 'g'))) AS name_md5, md5(trim(regexp_replace(regexp_replace(" + SQL_PLAIN + r", '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS text_md5 FROM documents WHERE text IS NOT NULL")
def normalized_texts(spark, d):
    """Whole texts as names (no marks, no other signs) and as plain text (composed, straight quotes, single spaces)."""
    docs = T.read(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(P.normal_name(F.col("text"))).alias("name_md5"), F.md5(P.composed_text(F.col("text"))).alias("text_md5"))
