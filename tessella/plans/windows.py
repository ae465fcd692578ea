"""Ordered analytics: latest rows, damping, sessions, anomalies, ranks and trends."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators.timing import damped, islands, sessions
from .base import Tables, plan


@plan("wn01_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest(t: Tables):
    # The greatest (ts, id) of a group needs no sort: it is combined before the shuffle.
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")
    return t.events.groupBy("user_id", "event_type").agg(last).select("user_id", "event_type", "x.event_id", "x.value")


_STATE = "CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END"


@plan("wn02_flap_damping", f"""WITH e AS (SELECT user_id, event_id, ts, {_STATE} AS state FROM events), c AS (SELECT *, (state IS DISTINCT FROM lag(state) OVER w)::INT AS turn, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS len FROM r)
  SELECT event_id, last_value(CASE WHEN len >= 2 OR n = 1 THEN state END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS confirmed FROM l""")
def flap_damping(t: Tables):
    return damped(t.events.withColumn("state", F.expr(_STATE)), ["user_id"], ["ts", "event_id"], "state", 2).select("event_id", "confirmed")


@plan("wn03_incidents", f"""WITH e AS (SELECT user_id, event_id, ts, {_STATE} AS state FROM events), c AS (SELECT *, (state IS DISTINCT FROM lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS turn FROM e),
  r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM c) SELECT user_id, island::BIGINT AS island, count(*) AS observations, min(ts) AS opened, max(ts) AS last_seen FROM r WHERE state = 'down' GROUP BY ALL""")
def incidents(t: Tables):
    e = islands(t.events.withColumn("state", F.expr(_STATE)), ["user_id"], ["ts", "event_id"], "state")
    return e.where("state = 'down'").groupBy("user_id", "island").agg(F.count("*").alias("observations"), F.min("ts").alias("opened"), F.max("ts").alias("last_seen"))


@plan("wn04_idle_gap_sessions", """WITH e AS (SELECT user_id, ts, event_id, (ts - lag(ts) OVER w > INTERVAL 6 HOUR)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM e) SELECT user_id, session_no::BIGINT AS session_no, count(*) AS n, min(ts) AS opened FROM s GROUP BY ALL""")
def idle_sessions(t: Tables):
    return sessions(t.events, ["user_id"], "ts", 6 * 3600, "event_id").groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("opened"))


@plan("wn04_session_window", """WITH e AS (SELECT user_id, ts, event_id, (ts - lag(ts) OVER w > INTERVAL 6 HOUR)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM e) SELECT user_id, min(ts) AS opened, count(*) AS n FROM s GROUP BY user_id, session_no""")
def session_windows(t: Tables):
    return t.events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.min("ts").alias("opened"), F.count("*").alias("n")).drop("session_window")


@plan("wn05_redundant_steps", """WITH e AS (SELECT user_id, event_type, (event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS same, ts, event_id FROM events)
  SELECT user_id, coalesce(sum(same), 0)::BIGINT AS redundant, arg_max(event_type, (ts, event_id)) AS terminal, round(avg((event_type <> 'error')::INT), 6) AS ok FROM e GROUP BY ALL""")
def redundant_steps(t: Tables):
    same = F.col("event_type") == F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.withColumn("same", same).groupBy("user_id").agg(
        F.count_if("same").alias("redundant"), F.max_by("event_type", F.struct("ts", "event_id")).alias("terminal"), F.round(F.avg((F.col("event_type") != "error").cast("int")), 6).alias("ok")
    )


@plan("wn06_series_anomalies", """WITH w AS (SELECT event_id, value, event_id <= lag(event_id) OVER o AS again, min(value) OVER p AS low, count(value) OVER p AS seen FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id),
  p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT event_id, seen >= 4 AND value > greatest(0.5, 8 * low) AS spike FROM w WHERE seen >= 4""")
def series_anomalies(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-8, -1)
    e = t.events.withColumn("low", F.min("value").over(w)).withColumn("seen", F.count("value").over(w))
    return e.where("seen >= 4").select("event_id", (F.col("value") > F.greatest(F.lit(0.5), 8 * F.col("low"))).alias("spike"))


@plan("wn07_advantages", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-8), 5) AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def advantages(t: Tables):
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round((F.col("l_quantity") - F.avg("l_quantity").over(w)) / (F.stddev_pop("l_quantity").over(w) + 1e-8), 5).alias("advantage"))


@plan("wn08_pct_change", """WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS v FROM events GROUP BY ALL) SELECT user_id, day::VARCHAR AS day, CASE WHEN lag(v) OVER w = 0 AND v = 0 THEN 0.0 WHEN lag(v) OVER w = 0 THEN NULL ELSE round(100 * (v - lag(v) OVER w) / lag(v) OVER w, 1) END AS pct_1,
  round(100 * (v - lag(v, 3) OVER w) / nullif(lag(v, 3) OVER w, 0), 1) AS pct_3 FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def pct_change(t: Tables):
    w = Window.partitionBy("user_id").orderBy("day")
    d = t.events.groupBy("user_id", F.col("ts").cast("date").cast("string").alias("day")).agg(F.count("*").alias("v"))
    pct = lambda k: F.when((F.lag("v", k).over(w) == 0) & (F.col("v") == 0), 0.0).otherwise(F.round(F.try_divide(100 * (F.col("v") - F.lag("v", k).over(w)), F.lag("v", k).over(w)), 1))
    return d.select("user_id", "day", pct(1).alias("pct_1"), pct(3).alias("pct_3"))


@plan("wn09_expanding_rank", """SELECT a.event_id, round((count(*) FILTER (b.value < a.value) + 0.5 * count(*) FILTER (b.value = a.value)) / count(*), 6) AS rank FROM events a JOIN events b ON a.user_id = b.user_id AND (b.ts, b.event_id) < (a.ts, a.event_id) GROUP BY a.event_id HAVING count(*) >= 5""")
def expanding_rank(t: Tables):
    from ..operators.folds import expanding_shares

    e = t.events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), "value")
    return expanding_shares(e, "user_id", ["at", "event_id"], "value", "event_id").where("seen >= 5").select("event_id", F.round("share", 6).alias("rank"))


@plan("wn10_slowest", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice IS NOT NULL ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
def slowest(t: Tables):
    return t.lineitem.where("l_extendedprice IS NOT NULL").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(20).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@plan("wn11_history", "SELECT event_id, event_type FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 30")
def history(t: Tables):
    return t.events.where("user_id = 8").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "event_type")


@plan("wn12_suppression")
def suppression(t: Tables):
    from ..operators.folds import suppressed

    e = t.events.where("event_type = 'error'").select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return suppressed(e, "user_id", "at", "event_id", 86_400.0)


@plan("wn13_collapse", """SELECT user_id, event_id, event_type, n - 1 AS others FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'error') DESC, ts DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def collapse(t: Tables):
    best = F.max_by(F.struct("event_id", "event_type"), F.struct((F.col("event_type") == "error"), "ts", -F.col("event_id"))).alias("x")
    return t.events.groupBy("user_id").agg(best, (F.count("*") - 1).alias("others")).select("user_id", "x.event_id", "x.event_type", "others")


@plan("wn14_trend", "SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS delta FROM orders")
def trend(t: Tables):
    return t.orders.select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")), 2).alias("delta"))


@plan("wn16_page_numbers", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank BETWEEN 3 AND 6")
def page_numbers(t: Tables):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", rank.cast("long").alias("rank")).where("rank between 3 and 6")


@plan("wn17_staleness", """SELECT user_id, CASE WHEN max(ts) IS NULL THEN 'never' WHEN greatest(epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)), 0) > 172800 THEN 'stale' WHEN greatest(epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)), 0) > 86400 THEN 'late' ELSE 'ok' END AS verdict
  FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN ts END AS ts FROM events) GROUP BY ALL""")
def staleness(t: Tables):
    age = F.greatest(F.lit("2024-01-31").cast("timestamp").cast("double") - F.max("ts").cast("timestamp").cast("double"), F.lit(0.0))
    return t.events.select("user_id", F.when(F.col("event_type") == "purchase", F.col("ts")).alias("ts")).groupBy("user_id").agg(F.when(F.max("ts").isNull(), "never").when(age > 172800, "stale").when(age > 86400, "late").otherwise("ok").alias("verdict"))


@plan("wn15_chain_walk", """WITH RECURSIVE p AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), c AS (SELECT event_id AS start, event_id AS node, 0 AS depth FROM p
  UNION ALL SELECT c.start, p.prev, c.depth + 1 FROM c JOIN p ON p.event_id = c.node WHERE p.prev IS NOT NULL AND c.depth < 5) SELECT start, node, depth FROM c""")
def chain_walk(t: Tables):
    # The k-th predecessor is a lag: the walk is one window.
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = F.array(*(F.struct(F.lit(k).alias("depth"), (F.lag("event_id", k).over(w) if k else F.col("event_id")).alias("node")) for k in range(6)))
    e = t.events.withColumn("steps", steps)
    return e.select(F.col("event_id").alias("start"), F.explode("steps").alias("x")).select("start", "x.node", "x.depth").where("node is not null")
