"""Retrieval: BM25, TF-IDF, dense neighbours and their measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.nearest import nearest_rows
from ..operators.ranking_models import bm25, cosine_top, postings
from .base import Tables, plan

_P = "w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), p AS (SELECT id, term, len, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM w) GROUP BY ALL)"
_BM25 = f"""WITH {_P}, z AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  s AS (SELECT query_id, p.id, round(sum(ln(1 + (z.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term), z GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def _ranked(t: Tables):
    return bm25(t.documents, "doc_id", t.benchmark.select(F.col("item_id").alias("query_id"), "text"))


@plan("dd17_bm25", _BM25 + " SELECT query_id, id, round(score, 4) AS score FROM r WHERE rank <= 10")
def bm25_top(t: Tables):
    return _ranked(t).select("query_id", "id", F.round("score", 4).alias("score"))


@plan("dd20_ranking_measures", _BM25 + """, g AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), h AS (SELECT query_id, min(rank) FILTER (g.id IS NOT NULL) AS first, sum(CASE WHEN g.id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(g.id) AS found FROM r LEFT JOIN g USING (query_id, id) WHERE rank <= 10 GROUP BY query_id)
  SELECT query_id, round(coalesce(1.0 / first, 0), 6) AS rr, round(dcg, 6) AS dcg, found FROM h""")
def ranking_measures(t: Tables):
    g = t.documents.join(F.broadcast(t.benchmark.select(F.col("item_id").alias("gq"), F.col("text").alias("item"))), F.col("text").contains(F.col("item"))).select("gq", F.col("doc_id").alias("gid"))
    r = _ranked(t).join(g, (F.col("query_id") == F.col("gq")) & (F.col("id") == F.col("gid")), "left")
    hit = F.col("gid").isNotNull()
    m = r.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.count("gid").alias("found"))
    return m.select("query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round("dcg", 6).alias("dcg"), "found")


@plan("ag15_tfidf", f"WITH {_P}, n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, sum(tf)::BIGINT AS count, round(ln((n + 1) / (count(*) + 1)) + 1, 6) AS idf, round(sum(1 + ln(tf)) * (ln((n + 1) / (count(*) + 1)) + 1) / n, 6) AS weight FROM p, n GROUP BY term, n HAVING count(*) >= 3")
def tfidf(t: Tables):
    n = t.documents.agg(F.count("*").alias("n"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    g = postings(t.documents, "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("count"), F.sum(1 + F.log("tf")).alias("s")).where("df >= 3").join(F.broadcast(n))
    return g.select("term", "df", "count", F.round(idf, 6).alias("idf"), F.round(F.col("s") * idf / F.col("n"), 6).alias("weight"))


@plan("ag16_postings", f"WITH {_P} SELECT id, count(*) AS terms, sum(tf)::BIGINT AS length FROM p GROUP BY id")
def posting_index(t: Tables):
    return postings(t.documents, "doc_id").groupBy("id").agg(F.count("*").alias("terms"), F.sum("tf").alias("length"))


_COS = "WITH v AS (SELECT vec_id, embedding[1:{d}]::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.v, c.v) / sqrt(list_inner_product(q.v, q.v)) / sqrt(list_inner_product(c.v, c.v)), 6) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, floor(score * 10000 + 0.5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"


def _shortened():
    return F.when(F.isnan("score"), F.col("score")).otherwise(F.floor(F.col("score") * 10000 + 0.5).cast("double")).alias("score")


@plan("dd21_dense_top", _COS.format(d=64))
def dense_top(t: Tables):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return cosine_top(t.embeddings, q, 5, dims=64).select("query_id", "vec_id", _shortened())


@plan("dd27_truncated", _COS.format(d=16))
def truncated(t: Tables):
    q = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return cosine_top(t.embeddings, q, 5, dims=16).select("query_id", "vec_id", _shortened())


@plan("dd28_content_gap", "WITH a AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark), b AS (SELECT term, count(*) AS want FROM a GROUP BY term), d AS (SELECT term, count(*) AS have FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term) SELECT term, CASE WHEN have IS NULL THEN 'missing' WHEN have < want THEN 'thin' WHEN have > 50 * want THEN 'overused' ELSE 'covered' END AS state FROM b LEFT JOIN d USING (term)")
def content_gap(t: Tables):
    terms = lambda df, n: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("term")).groupBy("term").agg(F.count("*").alias(n))
    j = terms(t.benchmark, "want").join(terms(t.documents, "have"), "term", "left")
    return j.select("term", F.when(F.col("have").isNull(), "missing").when(F.col("have") < F.col("want"), "thin").when(F.col("have") > 50 * F.col("want"), "overused").otherwise("covered").alias("state"))


@plan("dd22_exact_l2", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.v, q.v) + list_inner_product(c.v, c.v) - 2 * list_inner_product(q.v, c.v), 5) AS d FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
  SELECT query_id, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 3""")
def exact_l2(t: Tables):
    v = t.embeddings.select("vec_id", F.col("embedding").alias("v"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return nearest_rows(v, q, 3, "l2", 5).select("query_id", "vec_id")


@plan("jn13_lsh_pairs")
def lsh_pairs(t: Tables):
    from ..operators.similarity import minhash_pairs

    return minhash_pairs(t.documents, "doc_id", 5, 0.8)
