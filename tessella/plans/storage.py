"""What storage engines answer: point and range look-ups, last writes, replays, downsampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .base import Tables, plan


@plan("db01_point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 4242")
def point_lookup(t: Tables):
    return t.orders.where("o_orderkey = 4242").select("o_orderkey", "o_totalprice")


@plan("db02_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1300")
def range_scan(t: Tables):
    return t.orders.where("o_orderkey BETWEEN 1000 AND 1300").orderBy("o_orderkey").select("o_orderkey", "o_totalprice")


@plan("db04_document_filter", "SELECT event_id, event_type AS name FROM events WHERE (props->>'$.k')::INT >= 30 AND list_contains([event_type, 'any'], 'click')")
def document_filter(t: Tables):
    doc = F.struct(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("int").alias("age"))
    e = t.events.select("event_id", doc.alias("user"), F.array("event_type", F.lit("any")).alias("tags"))
    return e.where((F.col("user.age") >= 30) & F.array_contains("tags", "click")).select("event_id", "user.name")


@plan("db05_key_value", "SELECT user_id AS k, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL")
def key_value(t: Tables):
    return t.events.groupBy(F.col("user_id").alias("k")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))


@plan("db06_column_sum", "SELECT round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem")
def column_sum(t: Tables):
    return t.lineitem.agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count("*").alias("n"))


@plan("db08_downsample", """SELECT (epoch(ts) - epoch(TIMESTAMP '2024-01-01'))::BIGINT // 3600 AS bucket, count(*) AS n, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM (SELECT date_trunc('second', ts) AS ts, value FROM events) GROUP BY 1""")
def downsample(t: Tables):
    bucket = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 3600).alias("bucket")
    return t.events.groupBy(bucket).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("mean"))


@plan("db09_lsm", """SELECT k, v FROM (SELECT user_id AS k, CASE WHEN event_type <> 'error' THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND v IS NOT NULL""")
def lsm(t: Tables):
    last = F.max_by(F.struct(F.when(F.col("event_type") != "error", F.col("value")).alias("v")), F.struct("ts", "event_id")).alias("x")
    return t.events.groupBy(F.col("user_id").alias("k")).agg(last).select("k", "x.v").where("v is not null")


@plan("db10_wal_replay", """WITH c AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1), w AS (SELECT l.*, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem l SEMI JOIN c USING (l_orderkey))
  SELECT l_partkey AS k, l_quantity AS v FROM w WHERE rn = 1""")
def wal_replay(t: Tables):
    commits = t.lineitem.where("l_linestatus = 'F' AND l_linenumber = 1").select("l_orderkey").distinct()
    redo = t.lineitem.join(commits, "l_orderkey", "left_semi")
    return redo.groupBy(F.col("l_partkey").alias("k")).agg(F.max_by("l_quantity", F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")).alias("v"))


@plan("sm07_tumbling", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def tumbling(t: Tables):
    return t.events.groupBy(F.window("ts", "5 minutes")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), "n")


@plan("sm14_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS s FROM events) GROUP BY ALL")
def sliding(t: Tables):
    return t.events.groupBy(F.window("ts", "7 days", "1 day")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


@plan("ud07_fold", "SELECT c_mktsegment AS k, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM customer GROUP BY ALL")
def fold(t: Tables):
    return t.customer.groupBy(F.col("c_mktsegment").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.min("c_custkey").alias("first_key"), F.max("c_custkey").alias("last_key"))
