"""Retrieval queries: dense, keyword, fusion, diversity, the whole composition."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import retrieval as rt
from ..operators.clustering import mean_unit_vector
from ..sources import tables as t
from . import sql as q
from .catalog import query

AS_OF = "TIMESTAMP '2024-06-01 00:00:00'"


def label_queries(spark, folder):
    """One query for each label: the mean direction of its vectors; some with a time window."""
    e = t.table(spark, folder, "embeddings")
    c = mean_unit_vector(e, ["label"], "embedding")
    on = F.col("label") % 3 == 1
    return c.select(
        F.col("label").cast("long").alias("query_id"), "vector",
        F.when(on, F.expr("TIMESTAMP '2017-01-01 00:00:00'")).alias("lo"),
        F.when(on, F.timestamp_seconds(F.lit(1483228800) + F.col("label") * 86400 * 30)).alias("hi"))


CENTROIDS = """parts AS (SELECT label, i, sum(embedding[i]::DOUBLE / n) AS s FROM (
  SELECT label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL),
sums AS (SELECT label, list(s ORDER BY i) AS v FROM parts GROUP BY label),
centroids AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS vector FROM sums)"""

_DENSE = f"""{q.MEMORIES}, {CENTROIDS},
queries AS (SELECT CAST(label AS BIGINT) AS query_id, vector AS qv, CASE WHEN label % 3 = 1 THEN TIMESTAMP '2017-01-01' END AS lo,
   CASE WHEN label % 3 = 1 THEN make_timestamp((1483228800 + label::BIGINT * 86400 * 30) * 1000000) END AS hi FROM centroids),
scored AS (SELECT query_id, memory_id, round({{sim}}, 9) AS similarity FROM queries JOIN memories
   ON vector IS NOT NULL AND (lo IS NULL OR (ts >= lo AND ts < hi)) AND trust IN ('public', 'personal')),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) - 1 AS rank FROM scored)
SELECT query_id, memory_id, round(similarity, 6) AS similarity, rank FROM top WHERE rank < 32"""


def _dense(spark, folder, metric):
    m = t.memories(spark, folder).where(rt.search_filter("personal"))
    d = rt.dense_top(label_queries(spark, folder), m, 32, metric)
    return d.select("query_id", "memory_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("v2_dense_top_l2", f"WITH {_DENSE.replace('{sim}', '1.0 - list_sum(list_transform(list_zip(qv, vector::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))')}")
def v2(spark, folder):
    return _dense(spark, folder, "l2")


@query("v2_dense_top_cosine", f"WITH {_DENSE.replace('{sim}', 'list_cosine_similarity(qv, vector::DOUBLE[])')}")
def v2_cosine(spark, folder):
    return _dense(spark, folder, "cosine")


@query("p3_metadata_filter", f"""
WITH {q.MEMORIES} SELECT memory_id FROM memories WHERE trust IN ('public', 'personal') AND kind IN ('photo', 'diary') AND ts >= TIMESTAMP '2017-06-01' AND ts < TIMESTAMP '2019-01-01'""")
def p3(spark, folder):
    m = t.memories(spark, folder).where(rt.search_filter("personal", ["photo", "diary"]))
    return m.where("ts >= TIMESTAMP '2017-06-01' AND ts < TIMESTAMP '2019-01-01'").select("memory_id")


_TERMS = r"regexp_extract_all(lower({c}), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')"


def _terms(c):
    return _TERMS.replace("{c}", c)


_KEYWORD = f"""
WITH docs AS (SELECT doc_id, {_terms('text')} AS w FROM documents),
numbers AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS len FROM (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM docs) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT item_id, unnest(list_distinct({_terms('text')})) AS term FROM benchmark),
score AS (SELECT item_id, doc_id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score
 FROM asked JOIN tf USING (term) JOIN df USING (term), numbers GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM score)
SELECT item_id AS query_id, doc_id AS memory_id, round(score, 6) AS score, rank FROM top WHERE rank < 24"""


def _keyword(spark, folder, table):
    queries = t.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    k = rt.keyword_top(queries, t.memories(spark, folder), 24, table)
    return k.select("query_id", "memory_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("v3_keyword_top", _KEYWORD)
def v3(spark, folder):
    return _keyword(spark, folder, None)


@query("v3_incremental_index", _KEYWORD)
def v3_incremental(spark, folder):
    """The table of half the memories, then of all of them: an append adds the rest."""
    m = t.memories(spark, folder)
    table = rt.term_table(m.where("memory_id % 2 = 0"))
    table.append(m)
    return _keyword(spark, folder, table)


@query("v4_rank_fusion", """
WITH d AS (SELECT doc_id % 20 AS query_id, doc_id // 20 AS key, (n_chars % 1000) / 1000.0::DOUBLE AS similarity,
   row_number() OVER (PARTITION BY doc_id % 20 ORDER BY n_chars % 1000 DESC, doc_id) - 1 AS rank FROM documents WHERE lang <> 'en'),
w AS (SELECT doc_id % 20 AS query_id, doc_id // 20 AS key, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY md5(text), doc_id) - 1 AS rank
   FROM documents WHERE doc_id % 20 < 15 AND lang <> 'fr'),
b AS (SELECT query_id, key, d.similarity, coalesce(1.0 / (60 + d.rank + 1), 0) + coalesce(1.0 / (60 + w.rank + 1), 0) AS rrf, w.rank IS NOT NULL AS hit FROM d FULL JOIN w USING (query_id, key)),
m AS (SELECT *, max(rrf) OVER p AS top, coalesce(nullif(max(similarity) OVER p, 0), 1.0) AS best, bool_or(hit) OVER p AS any_hit FROM b WINDOW p AS (PARTITION BY query_id))
SELECT query_id, key, round(CASE WHEN any_hit THEN greatest(coalesce(similarity, 0), best * (rrf / top)) ELSE similarity END, 6) AS similarity, round(CAST(rrf AS DOUBLE), 9) AS rrf FROM m""")
def v4(spark, folder):
    d = t.table(spark, folder, "documents").select(
        (F.col("doc_id") % 20).alias("query_id"), F.floor(F.col("doc_id") / 20).alias("key"), "doc_id", "n_chars", "lang", F.md5("text").alias("h"))
    by = Window.partitionBy("query_id")
    dense = d.where("lang <> 'en'").withColumn("similarity", (F.col("n_chars") % 1000) / 1000.0).withColumn(
        "rank", F.row_number().over(by.orderBy((F.col("n_chars") % 1000).desc(), "doc_id")) - 1)
    keyword = d.where("lang <> 'fr' AND query_id < 15").withColumn("rank", F.row_number().over(by.orderBy("h", "doc_id")) - 1)
    row = F.struct("doc_id").alias("row")
    out = rt.fuse(dense.select("query_id", "key", "similarity", "rank", row), keyword.select("query_id", "key", "rank", row))
    return out.select("query_id", "key", F.round("similarity", 6).alias("similarity"), F.round("rrf", 9).alias("rrf"))


@query("v5_diversified", f"""
WITH RECURSIVE {q.MEMORIES}, {CENTROIDS},
scored AS (SELECT CAST(c.label AS BIGINT) AS query_id, memory_id, m.vector::DOUBLE[] AS v, round(list_cosine_similarity(c.vector, m.vector::DOUBLE[]), 9) AS score FROM centroids c JOIN memories m ON m.vector IS NOT NULL),
cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS pos FROM scored QUALIFY pos < 48),
alike AS MATERIALIZED (SELECT a.query_id, a.pos AS i, b.pos AS j, list_cosine_similarity(a.v, b.v) AS s FROM cand a JOIN cand b USING (query_id)),
walk AS (SELECT query_id, 1 AS k, [0::BIGINT] AS picked FROM cand WHERE pos = 0
 UNION ALL SELECT query_id, k + 1, list_append(picked, best) FROM (
  SELECT query_id, k, picked, arg_max(pos, (value, -pos)) AS best FROM (
   SELECT w.query_id, w.k, w.picked, c.pos, round(c.score - 0.45 * max(a.s), 12) AS value FROM walk w JOIN cand c ON c.query_id = w.query_id AND NOT list_contains(w.picked, c.pos)
   JOIN alike a ON a.query_id = w.query_id AND a.i = c.pos AND list_contains(w.picked, a.j) WHERE w.k < 8 GROUP BY w.query_id, w.k, w.picked, c.pos, c.score)
  GROUP BY query_id, k, picked)),
last AS (SELECT query_id, arg_max(picked, k) AS picked FROM walk GROUP BY query_id),
picks AS (SELECT query_id, unnest(picked) AS pos, CAST(generate_subscripts(picked, 1) AS INTEGER) AS pick FROM last)
SELECT query_id, memory_id, pick FROM picks JOIN cand USING (query_id, pos)""")
def v5(spark, folder):
    m = t.memories(spark, folder)
    d = rt.dense_top(label_queries(spark, folder).drop("lo", "hi"), m, 48, "cosine")
    cand = d.join(m.select("memory_id", "vector"), "memory_id").select(
        "query_id", "memory_id", "vector", F.col("similarity").alias("score"), F.col("rank").alias("position"))
    return rt.diversify(cand, 8).select("query_id", "memory_id", "pick")


@query("v6_gather")
def v6(spark, folder):
    k = F.col("item_id") % 5
    asked = F.when(k == 0, F.concat("text", F.lit(" in 2019"))).when(k == 1, F.concat(F.lit("koi photo hai "), "text")).when(
        k == 2, F.concat(F.lit("meri purani photo "), "text")).when(k == 3, F.concat("text", F.lit(" in 2012"))).otherwise(F.col("text"))
    v = t.table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    queries = t.table(spark, folder, "benchmark").join(v, "item_id").select(F.col("item_id").alias("query_id"), asked.alias("text"), "vector")
    out = rt.gather(queries, t.memories(spark, folder), 8, F.expr(AS_OF))
    return out.select("query_id", "memory_id", "kind", F.round("score", 6).alias("score"), "pick")
