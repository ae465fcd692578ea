"""Lexical and dense ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .nearest import nearest_rows


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, term, tf, len): the terms of each text, runs of a-z and digits in lower case."""
    w = docs.select(F.col(key).alias("id"), F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0).alias("w"))
    return w.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("id", "term", "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, queries: DataFrame, k1: float = 1.2, b: float = 0.75, top: int = 10) -> DataFrame:
    """(query_id, id, score, rank) of the ``top`` documents for each query (query_id, text), any term matching."""
    terms = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))).alias("term"))
    p = postings(docs, key)
    size = docs.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("len")).agg(F.count("*").alias("N"), F.avg("len").alias("avgdl"))
    hit = p.join(terms.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    weighed = hit.join(df, "term").join(F.broadcast(size)).select("id", "term", part.alias("w"))  # size is one row
    scored = weighed.join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def cosine_top(vectors: DataFrame, queries: DataFrame, top: int, dims: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``top`` nearest by cosine of every query (query_id, q), itself left out.

    The queries are a stated set; they meet all rows in blocks, by matrix products.
    """
    cutoff = (lambda c: F.slice(c, 1, dims)) if dims else (lambda c: F.col(c))
    v, q = vectors.select("vec_id", cutoff("embedding").alias("v")), queries.select("query_id", cutoff("q").alias("q"))
    return nearest_rows(v, q, top, "cosine", 6)
