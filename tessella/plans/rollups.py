"""Aggregations and rollups over ledgers of events, orders and lines."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.columns import apdex_score, nearest_rank
from .base import Tables, plan


@plan("ag01_group_count", "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_count(t: Tables):
    return t.orders.groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@plan("ag02_conditional_sum", "SELECT coalesce(sum(l_quantity) FILTER (l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber <= 3), 0) AS ready FROM lineitem")
def conditional_sum(t: Tables):
    return t.lineitem.where("l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber <= 3").agg(F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("ready"))


@plan("ag03_corpus_stats", "SELECT count(*) AS docs, sum(n_chars)::BIGINT AS chars, count(DISTINCT source) AS sources, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END)::BIGINT AS english, min(n_chars) AS shortest, max(n_chars) AS longest, round(avg(n_chars), 4) AS mean_chars FROM documents")
def corpus_stats(t: Tables):
    return t.documents.agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("english"),
        F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 4).alias("mean_chars"),
    )


@plan("ag04_windowed_rollup", """SELECT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) AS bucket, count(*) AS n, count(*) FILTER (value IS NULL) AS errors, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean,
  array_to_string(list_sort(list_distinct(list((event_id % 3)::VARCHAR))), ',') AS sources FROM events GROUP BY ALL""")
def windowed_rollup(t: Tables):
    day = F.window("ts", "1 day")
    return t.events.groupBy("user_id", "event_type", day).agg(
        F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("errors"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 4).alias("mean"),
        F.array_join(F.array_sort(F.collect_set((F.col("event_id") % 3).cast("string"))), ",").alias("sources"),
    ).withColumn("bucket", F.col("window.start")).drop("window")


@plan("ag05_grouping_sets", "SELECT event_type AS level, user_id % 5 AS source, count(*) AS n FROM events WHERE value > 10 GROUP BY GROUPING SETS ((event_type), (user_id % 5), (), (event_type, user_id % 5))")
def grouping_sets(t: Tables):
    e = t.events.where("value > 10").select(F.col("event_type").alias("level"), (F.col("user_id") % 5).alias("source"))
    sets = [[F.col("level")], [F.col("source")], [], [F.col("level"), F.col("source")]]
    return e.groupingSets(sets, "level", "source").agg(F.count("*").alias("n"))


@plan("ag06_operation_stats", """SELECT l_returnflag AS service, l_linestatus AS name, count(*) AS calls, count(l_extendedprice) AS measured, count(*) FILTER (l_discount > 0.09) AS errors, round(count(*) FILTER (l_discount > 0.09) / count(*), 4) AS error_rate,
  quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS longest, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY ALL""")
def operation_stats(t: Tables):
    wrong = F.count_if(F.col("l_discount") > 0.09)
    return t.lineitem.groupBy(F.col("l_returnflag").alias("service"), F.col("l_linestatus").alias("name")).agg(
        F.count("*").alias("calls"), F.count("l_extendedprice").alias("measured"), wrong.alias("errors"), F.round(wrong / F.count("*"), 4).alias("error_rate"),
        *(nearest_rank("l_extendedprice", q).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))), F.max("l_extendedprice").alias("longest"), F.round(F.avg("l_extendedprice"), 4).alias("mean"),
    )


@plan("ag07_nearest_rank", "SELECT c_mktsegment AS segment, quantile_disc(c_acctbal, 0.9) AS p90 FROM customer GROUP BY ALL")
def nearest_ranks(t: Tables):
    return t.customer.groupBy(F.col("c_mktsegment").alias("segment")).agg(nearest_rank("c_acctbal", 0.9).alias("p90"))


@plan("ag08_median", "SELECT event_type, round(median(value), 6) AS median, round(count(*) FILTER (value > 100) / count(*), 6) AS fail_rate FROM events GROUP BY ALL")
def medians(t: Tables):
    return t.events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.count_if(F.col("value") > 100) / F.count("*"), 6).alias("fail_rate"))


@plan("ag09_apdex", """WITH c AS (SELECT count(*) FILTER (event_type <> 'error' AND value <= 30) AS s, count(*) FILTER (event_type <> 'error' AND value > 30 AND value <= 120) AS t, count(*) FILTER (value IS NOT NULL OR event_type = 'error') AS m FROM events)
  SELECT s AS satisfied, t AS tolerating, m - s - t AS frustrated, round((s + t / 2) / m, 6) AS apdex FROM c""")
def apdex(t: Tables):
    return t.events.agg(*apdex_score(F.col("value"), F.col("event_type") == "error", 30.0))


@plan("ag10_trace_rollup", """SELECT l_orderkey AS trace, arg_min(l_partkey, (l_linenumber, l_partkey)) AS root, round(max(l_linenumber * 10 + l_quantity) - min(l_linenumber * 10), 4) AS extent, array_to_string(list_sort(list_distinct(list(l_returnflag))), '') AS services, count(*) AS spans FROM lineitem GROUP BY ALL""")
def trace_rollup(t: Tables):
    start = F.col("l_linenumber") * 10
    return t.lineitem.groupBy(F.col("l_orderkey").alias("trace")).agg(
        F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("root"), F.round(F.max(start + F.col("l_quantity")) - F.min(start), 4).alias("extent"),
        F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("services"), F.count("*").alias("spans"),
    )


@plan("ag11_uptime", """SELECT user_id AS target, round(100 * count(*) FILTER (event_type <> 'error') / count(*), 2) AS up_pct, count(*) FILTER (event_type <> 'error') AS answered, quantile_disc(value, 0.95) FILTER (event_type <> 'error') AS p95 FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL""")
def uptime(t: Tables):
    up = F.col("event_type") != "error"
    e = t.events.where("ts >= TIMESTAMP_NTZ '2024-01-10'").withColumn("answer", F.when(up, F.col("value")))
    return e.groupBy(F.col("user_id").alias("target")).agg(F.round(100 * F.count_if(up) / F.count("*"), 2).alias("up_pct"), F.count_if(up).alias("answered"), nearest_rank("answer", 0.95).alias("p95"))


@plan("ag12_run_summary", "SELECT l_suppkey AS run, count(*) AS n, arg_min(l_discount, (l_orderkey, l_linenumber, l_partkey)) AS first, arg_max(l_discount, (l_orderkey, l_linenumber, l_partkey)) AS last, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY ALL")
def run_summary(t: Tables):
    step = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    return t.lineitem.groupBy(F.col("l_suppkey").alias("run")).agg(F.count("*").alias("n"), F.min_by("l_discount", step).alias("first"), F.max_by("l_discount", step).alias("last"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


@plan("ag13_run_pivot", """SELECT l_suppkey AS run, l_linenumber AS key, max(l_tax) FILTER (l_returnflag = 'A') AS a, max(l_tax) FILTER (l_returnflag = 'N') AS n, max(l_tax) FILTER (l_returnflag = 'R') AS r,
  round(max(l_tax) FILTER (l_returnflag = 'R') - max(l_tax) FILTER (l_returnflag = 'A'), 6) AS delta FROM lineitem GROUP BY ALL""")
def run_pivot(t: Tables):
    p = t.lineitem.groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("key")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_tax"))
    return p.select("run", "key", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"), F.round(F.col("R") - F.col("A"), 6).alias("delta"))


@plan("ag14_active_users", """WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events ORDER BY day DESC LIMIT 7) SELECT ts::DATE::VARCHAR AS day, count(DISTINCT user_id) AS dau, (SELECT count(DISTINCT user_id) FROM events WHERE ts::DATE IN (FROM d)) AS wau,
  count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases FROM events WHERE ts::DATE IN (FROM d) GROUP BY ALL""")
def active_users(t: Tables):
    e = t.events.withColumn("day", F.col("ts").cast("date").cast("string"))
    days = e.select("day").distinct().orderBy(F.desc("day")).limit(7)
    recent = e.join(F.broadcast(days), "day")  # seven rows
    kind = lambda k: F.count_if(F.col("event_type") == k)
    by_day = recent.groupBy("day").agg(F.count_distinct("user_id").alias("dau"), kind("view").alias("views"), kind("click").alias("clicks"), kind("purchase").alias("purchases"))
    return by_day.join(F.broadcast(recent.agg(F.count_distinct("user_id").alias("wau"))))


@plan("ag17_bar_series", """SELECT o_orderpriority AS series, o_orderstatus AS x, round(sum(o_totalprice) FILTER (o_totalprice < 400000), 2) AS y, count(*) FILTER (o_totalprice < 400000) - 1 AS folded, count(*) FILTER (NOT o_totalprice < 400000) AS skipped FROM orders GROUP BY ALL""")
def bar_series(t: Tables):
    good = F.col("o_totalprice") < 400000
    return t.orders.groupBy(F.col("o_orderpriority").alias("series"), F.col("o_orderstatus").alias("x")).agg(
        F.round(F.sum(F.when(good, F.col("o_totalprice"))), 2).alias("y"), (F.count_if(good) - 1).alias("folded"), F.count_if(~good).alias("skipped")
    )


@plan("ag18_histogram", "SELECT b.bucket::BIGINT AS bucket, count(d.doc_id) AS n FROM range(0, 10) b(bucket) LEFT JOIN documents d ON least(d.n_chars // 2000, 9) = b.bucket GROUP BY ALL")
def histogram(t: Tables):
    counts = t.documents.groupBy(F.least(F.floor(F.col("n_chars") / 2000), F.lit(9)).alias("bucket")).agg(F.count("doc_id").alias("n"))
    return t.spark.range(10).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0, ["n"])


@plan("ag19_issues", """SELECT event_type || ':' || (event_id % 10) AS fingerprint, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, max(value) AS worst FROM events GROUP BY ALL""")
def issues(t: Tables):
    mark = F.concat_ws(":", "event_type", (F.col("event_id") % 10).cast("string")).alias("fingerprint")
    return t.events.groupBy(mark).agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("value").alias("worst"))


@plan("ag20_exact_groups", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS keeper FROM documents GROUP BY text HAVING count(*) >= 2")
def exact_groups(t: Tables):
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where("n >= 2")


@plan("ag22_label_summary", "SELECT d.source AS family, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, round(avg(toxic), 6) AS toxic_rate FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL")
def label_summary(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("family")).agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.round(F.avg("toxic"), 6).alias("toxic_rate")
    )


_CONF = "(event_id * 7919 % 1000) / 1000.0"


@plan("ag23_calibration", f"""WITH p AS (SELECT {_CONF} AS c, (event_type IN ('view', 'click'))::INT AS y FROM events), b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS conf, avg(y) AS acc FROM p GROUP BY 1)
  SELECT round(sum(abs(conf - acc) * n) / sum(n), 6) AS ece FROM b""")
def calibration(t: Tables):
    p = t.events.select((F.col("event_id") * 7919 % 1000 / 1000).alias("c"), F.col("event_type").isin("view", "click").cast("int").alias("y"))
    b = p.groupBy(F.least(F.floor(F.col("c") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("conf"), F.avg("y").alias("acc"))
    return b.agg(F.round(F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("n")) / F.sum("n"), 6).alias("ece"))


@plan("ag24_merge_offers", """SELECT p_brand AS key, arg_max(p_name, (length(p_name), p_name)) AS name, min(p_retailprice) AS lowest, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS tags, count(*) AS offers FROM part GROUP BY ALL""")
def merge_offers(t: Tables):
    return t.part.groupBy(F.col("p_brand").alias("key")).agg(
        F.max_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("name"), F.min("p_retailprice").alias("lowest"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("tags"), F.count("*").alias("offers")
    )


@plan("ag25_module_rollup", "SELECT p_brand AS module, round(sum(p_size) / sum(p_retailprice), 6) AS coverage FROM part GROUP BY ALL")
def module_rollup(t: Tables):
    return t.part.groupBy(F.col("p_brand").alias("module")).agg(F.round(F.sum("p_size") / F.sum("p_retailprice"), 6).alias("coverage"))


@plan("ag26_approx_distinct")
def approx_distinct(t: Tables):
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@plan("ag27_hint_efficacy", "SELECT p_type AS hint, count(*) AS encounters, count(*) FILTER (l_returnflag = 'N') AS cleared, round(count(*) FILTER (l_returnflag = 'N') / count(*), 6) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def hint_efficacy(t: Tables):
    ok = F.count_if(F.col("l_returnflag") == "N")
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("hint")).agg(F.count("*").alias("encounters"), ok.alias("cleared"), F.round(ok / F.count("*"), 6).alias("rate"))


@plan("ag28_signatures", "SELECT p_name AS signature, count(DISTINCT p_brand) AS experiments, CASE WHEN count(DISTINCT p_brand) > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM part GROUP BY ALL HAVING count(DISTINCT p_brand) >= 3")
def signatures(t: Tables):
    g = t.part.groupBy(F.col("p_name").alias("signature")).agg(F.count_distinct("p_brand").alias("experiments")).where("experiments >= 3")
    return g.withColumn("confidence", F.when(F.col("experiments") > 5, "HIGH").otherwise("MEDIUM"))


@plan("ag32_service_rows", """SELECT user_id AS service, arg_max(event_type, (ts, event_id)) AS state, max(ts) FILTER (event_type = 'error') AS last_incident, round(100 * avg((event_type <> 'error')::INT), 2) AS up_pct FROM events GROUP BY ALL""")
def service_rows(t: Tables):
    bad = F.col("event_type") == "error"
    return t.events.groupBy(F.col("user_id").alias("service")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max(F.when(bad, F.col("ts"))).alias("last_incident"), F.round(100 * F.avg((~bad).cast("int")), 2).alias("up_pct"))


@plan("ag33_distinct", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct(t: Tables):
    return t.orders.select("o_orderpriority").distinct()


@plan("ag34_usage_audit", "SELECT event_type AS source, round(count(*) / (SELECT count(*) FROM events), 6) AS share, round(sum(value), 2) AS tokens, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY ALL")
def usage_audit(t: Tables):
    g = t.events.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("tokens"), nearest_rank("value", 0.5).alias("p50"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).drop("n")


@plan("ag35_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t: Tables):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plan("ag36_auc", """WITH p AS (SELECT value AS s, (event_type = 'purchase')::INT AS y FROM events), v AS (SELECT s, sum(y) AS pos, count(*) AS n FROM p GROUP BY s), r AS (SELECT pos, n, sum(n) OVER (ORDER BY s) - n + (n + 1) / 2 AS mid FROM v)
  SELECT round((sum(mid * pos) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))), 6) AS auc FROM r""")
def auc(t: Tables):
    from ..operators.scores import roc_auc

    return roc_auc(t.events.select(F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y")))


@plan("ag37_brier", f"SELECT round(avg(power(c - y, 2)), 6) AS brier, round(avg(((c >= 0.5)::INT = y)::INT), 6) AS accuracy, round(avg(abs(c - y)), 6) AS mae FROM (SELECT {_CONF} AS c, (event_type IN ('view', 'click'))::INT AS y FROM events)")
def brier(t: Tables):
    p = t.events.select((F.col("event_id") * 7919 % 1000 / 1000).alias("c"), F.col("event_type").isin("view", "click").cast("int").alias("y"))
    c, y = F.col("c"), F.col("y")
    return p.agg(F.round(F.avg(F.pow(c - y, F.lit(2))), 6).alias("brier"), F.round(F.avg(((c >= 0.5).cast("int") == y).cast("int")), 6).alias("accuracy"), F.round(F.avg(F.abs(c - y)), 6).alias("mae"))


@plan("ag38_weighted_moments", """WITH m AS (SELECT l_returnflag AS g, sum(l_quantity * l_discount) / sum(l_quantity) AS mu FROM lineitem GROUP BY 1)
  SELECT g, round(mu, 8) AS mean, round(CASE WHEN s = 0 THEN 1 ELSE s END, 8) AS sd FROM (SELECT g, any_value(mu) AS mu, sqrt(sum(l_quantity * power(l_discount - mu, 2)) / sum(l_quantity)) AS s FROM lineitem JOIN m ON g = l_returnflag GROUP BY g)""")
def weighted_moments(t: Tables):
    w, x = F.col("l_quantity"), F.col("l_discount")
    means = t.lineitem.groupBy(F.col("l_returnflag").alias("g")).agg((F.sum(w * x) / F.sum(w)).alias("mu"))
    apart = t.lineitem.join(means, F.col("l_returnflag") == F.col("g"))  # a second pass, as a difference of squares cancels
    g = apart.groupBy("g").agg(F.first("mu").alias("mu"), F.sqrt(F.sum(w * (x - F.col("mu")) ** 2) / F.sum(w)).alias("sd"))
    sd = F.col("sd")
    return g.select("g", F.round("mu", 8).alias("mean"), F.round(F.when(sd == 0, 1.0).otherwise(sd), 8).alias("sd"))


@plan("ag39_class_balance", "SELECT round(avg(toxic), 6) AS raw_rate, round(sum(toxic * (1 + quality)) / sum(1 + quality), 6) AS weighted_rate, count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic = 0) AS negatives FROM labels")
def class_balance(t: Tables):
    w = 1 + F.col("quality")
    return t.labels.agg(F.round(F.avg("toxic"), 6).alias("raw_rate"), F.round(F.sum(F.col("toxic") * w) / F.sum(w), 6).alias("weighted_rate"), F.count_if(F.col("toxic") == 1).alias("positives"), F.count_if(F.col("toxic") == 0).alias("negatives"))


@plan("ag41_scan_totals", "SELECT round(sum(p_retailprice) FILTER (p_size > 5), 2) AS total, count(*) FILTER (NOT p_size > 5) AS unmeasured, max(p_size) AS most, round(avg(p_size) FILTER (p_size > 5), 6) AS mean FROM part")
def scan_totals(t: Tables):
    ok = F.col("p_size") > 5
    return t.part.agg(F.round(F.sum(F.when(ok, F.col("p_retailprice"))), 2).alias("total"), F.count_if(~ok).alias("unmeasured"), F.max("p_size").alias("most"), F.round(F.avg(F.when(ok, F.col("p_size"))), 6).alias("mean"))


@plan("ag42_shard_yield", "SELECT o_custkey AS shard, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (o_orderstatus = 'F') / count(*) * ln(1 + sum(o_totalprice)) END, 6) AS score FROM orders GROUP BY ALL")
def shard_yield(t: Tables):
    return t.orders.groupBy(F.col("o_custkey").alias("shard")).agg(F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count("*") * F.log1p(F.sum("o_totalprice")), 6).alias("score"))


@plan("ag43_overall_status", "SELECT user_id, CASE max(CASE event_type WHEN 'error' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END) WHEN 3 THEN 'outage' WHEN 2 THEN 'degraded' ELSE 'operational' END AS status FROM events GROUP BY user_id")
def overall_status(t: Tables):
    rank = F.max(F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "signup", 2).otherwise(1))
    return t.events.groupBy("user_id").agg(F.when(rank == 3, "outage").when(rank == 2, "degraded").when(rank == 1, "operational").otherwise("no_data").alias("status"))


@plan("ag44_task_stats", "SELECT o_orderstatus AS outcome, count(*) AS n, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END), 4) AS mean_score, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS scored FROM orders GROUP BY ALL")
def task_stats(t: Tables):
    score = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    return t.orders.groupBy(F.col("o_orderstatus").alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg(score), 4).alias("mean_score"), F.count(score).alias("scored"))


@plan("ag30_release_accounting", "SELECT source, count(*) AS raw, count(*) FILTER (lang <> 'en') AS non_english, count(*) FILTER (lang = 'en' AND n_chars < 300) AS short, count(*) FILTER (lang = 'en' AND n_chars >= 300) AS kept, count(*) = count(*) FILTER (lang <> 'en') + count(*) FILTER (lang = 'en' AND n_chars < 300) + count(*) FILTER (lang = 'en' AND n_chars >= 300) AS balanced FROM documents GROUP BY ALL")
def release_accounting(t: Tables):
    bucket = F.when(F.col("lang") != "en", "non_english").when(F.col("n_chars") < 300, "short").otherwise("kept")
    p = t.documents.withColumn("bucket", bucket).groupBy("source").pivot("bucket", ["non_english", "short", "kept"]).count().na.fill(0)
    raw = t.documents.groupBy("source").agg(F.count("*").alias("raw"))
    return raw.join(p, "source").withColumn("balanced", F.col("raw") == F.col("non_english") + F.col("short") + F.col("kept"))


@plan("ag31_bootstrap_ci")
def bootstrap_ci(t: Tables):
    from ..operators.scores import bootstrap_mean

    return bootstrap_mean(t.events.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("value").alias("x")), 200, seed=7)
