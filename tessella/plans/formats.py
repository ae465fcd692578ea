"""Round trips through files: what is written in a format is read back by its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import readers, sinks
from .base import Tables, plan


def _place(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/tessella/{name}-{uuid.uuid4().hex}"


@plan("src04_csv", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_size::VARCHAR AS p_size FROM part")
def csv_round_trip(t: Tables):
    return readers.read_csv(t.spark, sinks.export_csv(t.part.select("p_partkey", "p_name", "p_size"), _place(t, "csv")))


@plan("src01_json_shard", "SELECT doc_id, source, n_chars FROM documents")
def json_shard(t: Tables):
    df, out = t.documents.select("doc_id", "source", "n_chars"), _place(t, "jsonl")
    df.write.option("compression", "gzip").json(out)
    return readers.read_jsonl(t.spark, out, df.schema).where("_corrupt IS NULL").drop("_corrupt")


@plan("src06_replay_bad_lines", "SELECT count(*) FILTER (event_id % 10 = 0) AS bad_lines FROM events")
def bad_lines(t: Tables):
    out = _place(t, "lines")
    line = F.when(F.col("event_id") % 10 == 0, F.lit('{"event_id": 1, "na')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    t.events.select(line.alias("value")).write.text(out)
    return readers.replay(t.spark, out, t.events.select("event_id", "event_type").schema)[1]


@plan("src05_json_records", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def json_records(t: Tables):
    out = _place(t, "records")
    t.nation.agg(F.struct(F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows")).alias("data")).write.json(out)
    return readers.read_json_records(t.spark, out, "data.rows").select("n_nationkey", "n_name")


@plan("src11_feed", "SELECT p_name AS title, 'http://x/' || p_partkey AS link, 'd' || p_size AS date FROM part")
def feed(t: Tables):
    item = F.concat(F.lit("<item><title>"), "p_name", F.lit("</title><link>http://x/"), F.col("p_partkey").cast("string"), F.lit("</link><pubDate>d"), F.col("p_size").cast("string"), F.lit("</pubDate></item>"))
    docs = t.part.groupBy(F.floor(F.col("p_partkey") / 50).alias("g")).agg(F.concat(F.lit('<?xml version="1.0"?><rss><channel>'), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("xml"))
    return readers.read_feed(docs)


@plan("src12_sitemap", "SELECT 'http://x/' || p_partkey AS loc, '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS lastmod FROM part")
def sitemap(t: Tables):
    entry = F.concat(F.lit("<url><loc>http://x/"), F.col("p_partkey").cast("string"), F.lit("</loc><lastmod>2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lit("</lastmod></url>"))
    docs = t.part.groupBy(F.floor(F.col("p_partkey") / 50).alias("g")).agg(F.concat(F.lit('<urlset xmlns="http://s">'), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    return readers.read_sitemap(docs)


@plan("src15_patch_lines", "SELECT 'f' || p_partkey AS path, 11 AS line, 'new ' || p_name AS text FROM part")
def patch(t: Tables):
    n = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("diff --git a/f"), n, F.lit(" b/f"), n, F.lit("\n--- a/f"), n, F.lit("\n+++ b/f"), n, F.lit("\n@@ -10,3 +10,3 @@\n same\n-old\n+new "), F.col("p_name"), F.lit("\n tail\n"))
    return readers.patch_lines(t.part.select(text.alias("patch")))


@plan("snk03_release_manifest", "SELECT o_orderstatus AS split, count(*) AS rows FROM orders GROUP BY ALL")
def release_manifest(t: Tables):
    df = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("split"))
    return sinks.write_release(df, _place(t, "release"), "split", "o_orderkey").select("split", "rows")


@plan("snk06_upsert", "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def upserted(t: Tables):
    e = t.events.groupBy("user_id", F.col("ts").alias("version"), "event_id").agg(F.max("value").alias("value"))

    rows = e.select("user_id", F.struct("version", "event_id").alias("version"), "value")
    old, new = rows.where("version.event_id % 2 = 0"), rows.where("version.event_id % 2 = 1")
    once = sinks.upsert(old, new, ["user_id"], "version")
    return sinks.upsert(once, new, ["user_id"], "version").select("user_id", "value")
