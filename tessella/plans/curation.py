"""The curation funnel: clean, language and quality gates, duplicates, contamination, split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from .base import Tables, plan
from .dedup import _GRAM, _NORM
from .joins import _grams
from .texts import _GOPHER

#: Shares of the train and dev splits; what is left is test.
SPLITS = (0.98, 0.01)


def split_of(key) -> F.Column:
    """Split of a key by the top 32 bits of its SHA-1."""
    share = F.conv(F.substring(F.sha1(key.cast("string")), 1, 8), 16, 10).cast("double") / 4294967295.0
    return F.when(share < SPLITS[0], "train").when(share < sum(SPLITS), "dev").otherwise("test")


def funnel(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, stage and reason of every document: the first gate that stops it, or ``kept`` with its split.

    The order is language, quality, duplicate, contamination, so a contaminated text still counts as the first of its
    duplicates.
    """
    d = docs.select("doc_id", "lang", "text", X.gopher_reason(F.col("text")).alias("quality"))
    ok = d.where("lang = 'en' AND quality IS NULL").groupBy(F.sha2(X.normalized(F.col("text")), 256)).agg(F.min("doc_id").alias("first_id")).select("first_id")
    grams = _grams(docs, "doc_id", 13).join(_grams(benchmark, "item_id", 13).select("gram").distinct(), "gram", "left_semi").select(F.col("id").alias("hit_id")).distinct()
    j = d.select("doc_id", "lang", "quality").join(ok, F.col("doc_id") == F.col("first_id"), "left").join(grams, F.col("doc_id") == F.col("hit_id"), "left")
    stage = F.when(F.col("lang") != "en", "non_english").when(F.col("quality").isNotNull(), "quality").when(F.col("first_id").isNull(), "duplicate").when(F.col("hit_id").isNotNull(), "contaminated").otherwise("kept")
    return j.select("doc_id", stage.alias("stage"), F.when(stage == "quality", F.col("quality")).when(stage == "kept", split_of(F.col("doc_id"))).alias("reason"))


_SPLIT = "CASE WHEN ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0 < 0.98 THEN 'train' WHEN ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0 < 0.99 THEN 'dev' ELSE 'test' END"
_STAGES = f"""WITH q AS ({_GOPHER}), o AS (SELECT min(doc_id) AS first_id FROM documents JOIN q USING (doc_id) WHERE lang = 'en' AND reason IS NULL GROUP BY {_NORM}),
  dg AS ({_GRAM.format(id='doc_id', table='documents')}), bg AS ({_GRAM.format(id='item_id', table='benchmark')}), hit AS (SELECT DISTINCT id FROM dg WHERE g IN (SELECT g FROM bg)),
  f AS (SELECT d.doc_id, CASE WHEN lang <> 'en' THEN 'non_english' WHEN q.reason IS NOT NULL THEN 'quality' WHEN d.doc_id NOT IN (SELECT first_id FROM o) THEN 'duplicate' WHEN d.doc_id IN (SELECT id FROM hit) THEN 'contaminated' ELSE 'kept' END AS stage, q.reason AS quality FROM documents d JOIN q USING (doc_id)),
  s AS (SELECT doc_id, stage, CASE stage WHEN 'quality' THEN quality WHEN 'kept' THEN {_SPLIT} END AS reason FROM f)"""


@plan("curation_funnel", _STAGES + " SELECT stage, reason, count(*) AS n FROM s GROUP BY ALL")
def curation_counts(t: Tables):
    return funnel(t.documents, t.benchmark).groupBy("stage", "reason").agg(F.count("*").alias("n"))


@plan("ag29_stage_decisions", _STAGES + " SELECT doc_id, stage, reason FROM s")
def decisions(t: Tables):
    return funnel(t.documents, t.benchmark)


@plan("snk04_decontam_report", f"WITH dg AS ({_GRAM.format(id='doc_id', table='documents')}), bg AS ({_GRAM.format(id='item_id', table='benchmark')}) SELECT source, 'benchmark' AS eval_set, count(DISTINCT id) AS n FROM dg JOIN documents ON doc_id = id WHERE g IN (SELECT g FROM bg) GROUP BY source")
def decontam_report(t: Tables):
    hit = _grams(t.documents, "doc_id", 13).join(_grams(t.benchmark, "item_id", 13).select("gram").distinct(), "gram", "left_semi").select(F.col("id").alias("doc_id")).distinct()
    return t.documents.join(hit, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n")).withColumn("eval_set", F.lit("benchmark"))
