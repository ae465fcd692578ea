"""Splits, packing, chunks, pairs and orderings for training sets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators.folds import floor_filter
from .base import Tables, plan
from .curation import _SPLIT, split_of


@plan("sp01_assign_split", f"SELECT doc_id, {_SPLIT} AS split FROM documents")
def assign_split(t: Tables):
    return t.documents.select("doc_id", split_of(F.col("doc_id")).alias("split"))


@plan("sp02_grouped_temporal", """WITH g AS (SELECT user_id, min(ts) AS first FROM events GROUP BY ALL), r AS (SELECT user_id, row_number() OVER (ORDER BY first, user_id) AS rn, count(*) OVER () AS n FROM g)
  SELECT user_id, CASE WHEN rn > n - n // 10 THEN 'test' WHEN rn > n - 2 * (n // 10) THEN 'dev' ELSE 'train' END AS split FROM r""")
def grouped_temporal(t: Tables):
    from ..operators.ranking import global_rank

    g = t.events.groupBy("user_id").agg(F.min("ts").alias("first"))
    n = g.count()
    rn = F.col("place") + 1
    split = F.when(rn > n - n // 10, "test").when(rn > n - 2 * (n // 10), "dev").otherwise("train")
    return global_rank(g, ["first", "user_id"]).select("user_id", split.alias("split"))


@plan("sp05_time_split", "SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'holdout' WHEN o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 30 DAY THEN 'train' END AS split FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' OR o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 30 DAY")
def time_split(t: Tables):
    split = F.expr("CASE WHEN o_orderdate >= TIMESTAMP_NTZ '2001-01-01' THEN 'holdout' WHEN o_orderdate < TIMESTAMP_NTZ '2000-12-02' THEN 'train' END")
    return t.orders.select("o_orderkey", split.alias("split")).where("split is not null")


@plan("sp07_conflicts", """SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, user_id % 3 AS lab FROM events) GROUP BY user_id, event_type HAVING count(DISTINCT value > 490) = 1""")
def conflicts(t: Tables):
    label = F.col("value") > 490
    g = t.events.groupBy("user_id", "event_type").agg(F.min(label).alias("a"), F.max(label).alias("b"), F.min("event_id").alias("event_id"))
    return g.where(F.col("a") == F.col("b")).select("user_id", "event_type", "event_id")


@plan("sp08_pack_offsets", """WITH n AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) + 1 AS n FROM documents)
  SELECT doc_id, (sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n)::BIGINT AS begins, (sum(n) OVER (PARTITION BY source ORDER BY doc_id))::BIGINT AS ends FROM n""")
def pack_offsets(t: Tables):
    from ..functions.text import tokens

    n = t.documents.select("doc_id", "source", (F.size(tokens(F.col("text"))) + 1).cast("long").alias("n"))
    ends = F.sum("n").over(Window.partitionBy("source").orderBy("doc_id"))
    return n.select("doc_id", (ends - F.col("n")).alias("begins"), ends.alias("ends"))


@plan("sp09_fixed_windows")
def fixed_windows(t: Tables):
    from ..functions.text import tokens

    w = t.documents.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    return w.groupBy("doc_id", F.floor(F.col("pos") / 64).alias("window")).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("x")).where("size(x) = 64").select("doc_id", "window", F.transform("x", lambda x: x["token"]).alias("tokens"))


@plan("sp10_chunks", "SELECT doc_id, i::BIGINT AS begins, sha1(substr(text, i::INT, 1000)) AS hash FROM documents, generate_series(1, greatest(len(text), 1), 900) g(i)")
def chunks(t: Tables):
    d = t.documents.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(900))).alias("at"))
    return d.select("doc_id", F.col("at").cast("long").alias("begins"), F.sha1(F.substring("text", F.col("at"), F.lit(1000))).alias("hash"))


@plan("sp11_phase", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 1 WHEN n_chars < 2000 THEN 2 WHEN n_chars < 8000 THEN 3 ELSE 4 END AS phase FROM documents")
def phase(t: Tables):
    return t.documents.select("doc_id", F.when(F.col("n_chars") < 500, 1).when(F.col("n_chars") < 2000, 2).when(F.col("n_chars") < 8000, 3).otherwise(4).alias("phase"))


@plan("sp13_demand_weights", "SELECT o_orderkey, round((1 + 2 * (o_orderkey % 5) / 4) * CASE o_orderpriority WHEN '1-URGENT' THEN 1.5 ELSE 1 END, 6) AS weight FROM orders")
def demand_weights(t: Tables):
    return t.orders.select("o_orderkey", F.round((1 + 2 * (F.col("o_orderkey") % 5) / 4) * F.when(F.col("o_orderpriority") == "1-URGENT", 1.5).otherwise(1.0), 6).alias("weight"))


@plan("sp14_eviction_order", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderpriority, o_orderstatus DESC, o_orderdate, o_orderkey LIMIT 100")
def eviction_order(t: Tables):
    return t.orders.where("o_orderstatus <> 'O'").orderBy("o_orderpriority", F.desc("o_orderstatus"), "o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@plan("sp15_preference_pairs", "SELECT a.l_orderkey, a.l_linenumber AS chosen, b.l_linenumber AS rejected FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity - b.l_quantity >= 40")
def preference_pairs(t: Tables):
    a = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("chosen"), F.col("l_quantity").alias("q1"))
    b = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("rejected"), F.col("l_quantity").alias("q2"))
    return a.join(b, "l_orderkey").where("q1 - q2 >= 40").select("l_orderkey", "chosen", "rejected")


@plan("sp16_floor_filter")
def floor_filtered(t: Tables):
    total = Window.partitionBy("o_orderpriority")
    rows = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").withColumn("total", F.sum("o_totalprice").over(total)).withColumn("low", F.col("total") * 0.5)
    return floor_filter(rows, "o_orderpriority", ["o_orderkey"], "o_totalprice", "total", "low").select("o_orderkey", "taken")


@plan("sp18_deficits", "WITH g AS (SELECT o_orderpriority AS phase, count(*) AS ready FROM orders GROUP BY ALL), d AS (SELECT phase, greatest(0, 3050 - ready) AS deficit FROM g) SELECT phase, deficit::BIGINT AS deficit, round(greatest(0.15, coalesce(deficit / nullif(sum(deficit) OVER (), 0), 0)), 6) AS effort FROM d")
def deficits(t: Tables):
    d = t.orders.groupBy(F.col("o_orderpriority").alias("phase")).agg(F.greatest(F.lit(0), 3050 - F.count("*")).alias("deficit"))
    share = F.coalesce(F.try_divide("deficit", F.sum("deficit").over(Window.partitionBy())), F.lit(0.0))
    return d.select("phase", "deficit", F.round(F.greatest(F.lit(0.15), share), 6).alias("effort"))


@plan("sp03_holdout_groups", """WITH g AS (SELECT o_custkey, count(*) AS n, md5(o_custkey::VARCHAR) AS h FROM orders GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY h) - n AS before, sum(n) OVER () AS total FROM g) SELECT o_custkey, before < 0.2 * total AS held_out FROM r""")
def holdout_groups(t: Tables):
    from ..operators.ranking import running_sum

    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("h", F.md5(F.col("o_custkey").cast("string").cast("binary")))
    total = t.orders.count()
    return running_sum(g, ["h"], "n").select("o_custkey", (F.col("before") < 0.2 * total).alias("held_out"))


@plan("sp06_downsample", "SELECT event_id, CASE WHEN event_type = 'view' THEN 4 ELSE 1 END AS weight FROM events WHERE event_type <> 'view' OR ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 4 = 0")
def downsample(t: Tables):
    draw = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 4
    easy = F.col("event_type") == "view"
    return t.events.where(~easy | (draw == 0)).select("event_id", F.when(easy, 4).otherwise(1).alias("weight"))


@plan("sp12_mixture")
def mixture(t: Tables):
    return t.documents.sampleBy("lang", {"en": 0.2, "de": 0.5, "fr": 0.5, "es": 0.9}, seed=3).select("doc_id", "lang")


@plan("sp17_pack_conflicts", "SELECT min(p_partkey) AS p_partkey FROM part GROUP BY p_name, p_brand HAVING count(DISTINCT p_type) = 1")
def pack_conflicts(t: Tables):
    g = t.part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("p_partkey"), F.min("p_type").alias("a"), F.max("p_type").alias("b"))
    return g.where("a = b").select("p_partkey")
