"""Joins: inner, outer, semi, anti, as-of, interval, neighbour, similarity and containment."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators.siblings import nearest_siblings
from ..operators.timing import asof_join, bucketed_interval_join
from .base import Tables, plan


@plan("jn01_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def inner(t: Tables):
    c = t.customer.where("c_mktsegment = 'BUILDING'")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@plan("jn02_recall_or_like", """WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS term FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) AS term FROM documents)
  SELECT * FROM (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN d USING (term) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) <= 20""")
def recall_or_like(t: Tables):
    """Any term of an item recalls a document; the 20 that share most terms are given."""
    terms = lambda df, key: df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), 0))).alias("term"))
    hits = terms(t.documents, "doc_id").join(terms(t.benchmark, "item_id"), "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    best = Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id")
    return hits.withColumn("rn", F.row_number().over(best)).where("rn <= 20").drop("rn")


@plan("jn03_inner_three", "SELECT r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def inner_three(t: Tables):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@plan("jn04_attempts", "SELECT l_orderkey, l_linenumber, o_orderdate, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def attempts(t: Tables):
    o = t.orders.where("o_orderstatus = 'F'")
    return t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"))


@plan("jn05_route_outcome", """SELECT o_orderkey, m.flag AS outcome FROM orders LEFT JOIN
  (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS flag FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey) m ON o_orderkey = m.l_orderkey""")
def route_outcome(t: Tables):
    last = t.lineitem.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("outcome"))
    return t.orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "outcome")


_RUNS = "SELECT l_suppkey AS k, round(avg(l_discount), 6) AS v FROM lineitem WHERE l_shipdate {} TIMESTAMP{} '1998-06-01' AND l_suppkey % {} <> 0 GROUP BY l_suppkey"


def _runs(t: Tables):
    run = lambda cond, m: t.lineitem.where(f"l_shipdate {cond} TIMESTAMP_NTZ '1998-06-01' AND l_suppkey % {m} <> 0").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_discount"), 6).alias("v"))
    a, b = run("<", 7).withColumnRenamed("v", "old"), run(">=", 5).withColumnRenamed("v", "new")
    return a.join(b, "k", "full_outer")


@plan("jn06_run_diff", f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'removed' WHEN abs(b.v - a.v) < 0.005 THEN 'unchanged' WHEN b.v > a.v THEN 'improved' ELSE 'regressed' END AS verdict
  FROM ({_RUNS.format('<', '', 7)}) a FULL JOIN ({_RUNS.format('>=', '', 5)}) b ON a.k = b.k""")
def run_diff(t: Tables):
    delta = F.col("new") - F.col("old")
    verdict = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(F.abs(delta) < 0.005, "unchanged").when(delta > 0, "improved").otherwise("regressed")
    return _runs(t).select("k", verdict.alias("verdict"))


@plan("jn07_key_diff", f"""SELECT count(*) FILTER (a.k IS NULL) AS added, count(*) FILTER (b.k IS NULL) AS removed, count(*) FILTER (b.v < a.v) AS regressions, count(*) FILTER (b.v > a.v) AS improvements
  FROM ({_RUNS.format('<', '', 7)}) a FULL JOIN ({_RUNS.format('>=', '', 5)}) b ON a.k = b.k""")
def key_diff(t: Tables):
    c = F.col
    return _runs(t).agg(
        F.count_if(c("old").isNull()).alias("added"), F.count_if(c("new").isNull()).alias("removed"),
        F.count_if(c("new") < c("old")).alias("regressions"), F.count_if(c("new") > c("old")).alias("improvements"),
    )


_SCAN = "SELECT user_id AS url, bool_or(event_type = 'error' AND value > 450) AS broken FROM events WHERE ts {} TIMESTAMP{} '2024-01-16' AND user_id % {} <> 0 GROUP BY user_id"


@plan("jn08_scan_diff", f"""SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL AND b.broken THEN 'appeared_broken' WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed'
  WHEN a.broken AND b.broken THEN 'still_broken' WHEN b.broken THEN 'new_broken' WHEN a.broken THEN 'fixed' ELSE 'same' END AS change FROM ({_SCAN.format('<', '', 9)}) a FULL JOIN ({_SCAN.format('>=', '', 8)}) b ON a.url = b.url""")
def scan_diff(t: Tables):
    def scan(cond: str, m: int, name: str):
        broken = (F.col("event_type") == "error") & (F.col("value") > 450)
        return t.events.where(f"ts {cond} TIMESTAMP_NTZ '2024-01-16' AND user_id % {m} <> 0").groupBy(F.col("user_id").alias("url")).agg(F.bool_or(broken).alias(name))

    c = F.col
    change = (
        F.when(c("was").isNull() & c("now"), "appeared_broken").when(c("was").isNull(), "added").when(c("now").isNull(), "removed")
        .when(c("was") & c("now"), "still_broken").when(c("now"), "new_broken").when(c("was"), "fixed").otherwise("same")
    )
    return scan("<", 9, "was").join(scan(">=", 8, "now"), "url", "full_outer").select("url", change.alias("change"))


@plan("jn09_link_survey", """SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN 'uncrawled' WHEN p_size > 45 THEN 'unreachable' WHEN p_type = 'PROMO' THEN 'broken' WHEN p_brand = 'Brand#1' THEN 'redirect' ELSE 'ok' END AS state
  FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 3) p ON l_partkey = p_partkey""")
def link_survey(t: Tables):
    p = t.part.where("p_partkey % 10 <> 3")
    state = F.when(F.col("p_partkey").isNull(), "uncrawled").when(F.col("p_size") > 45, "unreachable").when(F.col("p_type") == "PROMO", "broken").when(F.col("p_brand") == "Brand#1", "redirect").otherwise("ok")
    return t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", state.alias("state"))


@plan("jn10_orphans", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey <> c_custkey)")
def orphans(t: Tables):
    links = t.orders.where("o_orderkey <> o_custkey")
    return t.customer.join(links, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@plan("jn11_membership", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def membership(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


_GRAMS = "SELECT DISTINCT {id} AS id, list_aggregate(w[i:i + {n} - 1], 'string_agg', ' ') AS gram FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {table}), range(1, len(w) - {n} + 2) r(i)"


def _grams(df, key: str, n: int):
    w = df.select(F.col(key).alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0).alias("w")).where(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))
    return w.select("id", F.explode(F.array_distinct(grams)).alias("gram"))


@plan("jn12_shared_shingles", f"""WITH g AS ({_GRAMS.format(id='conv_id', n=5, table='conversations')})
  SELECT a.id AS lo, b.id AS hi, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL""")
def shared_shingles(t: Tables):
    g = _grams(t.conversations, "conv_id", 5).distinct()
    a, b = g.select(F.col("id").alias("lo"), "gram"), g.select(F.col("id").alias("hi"), "gram")
    return a.join(b, "gram").where("lo < hi").groupBy("lo", "hi").agg(F.count("*").alias("shared"))


@plan("jn14_containment", f"""WITH d AS ({_GRAMS.format(id='doc_id', n=8, table='documents')}), b AS ({_GRAMS.format(id='item_id', n=8, table='benchmark')})
  SELECT DISTINCT d.id AS doc_id, b.id AS item_id FROM d JOIN b ON d.gram = b.gram""")
def containment(t: Tables):
    d, b = _grams(t.documents, "doc_id", 8), _grams(t.benchmark, "item_id", 8)
    return d.join(b.select(F.col("id").alias("item_id"), "gram"), "gram").select(F.col("id").alias("doc_id"), "item_id").distinct()


@plan("jn15_history", """WITH d AS (SELECT o_custkey AS site, o_orderdate::DATE AS day, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
  SELECT site, day::VARCHAR AS day, count(*) OVER w AS n_before, round(avg(v) OVER w, 4) AS mean_before FROM d WINDOW w AS (PARTITION BY site ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def history(t: Tables):
    d = t.orders.groupBy(F.col("o_custkey").alias("site"), F.col("o_orderdate").cast("date").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("site").orderBy(F.unix_date("day")).rangeBetween(Window.unboundedPreceding, -1)
    return d.select("site", F.col("day").cast("string").alias("day"), F.count("*").over(w).alias("n_before"), F.round(F.avg("v").over(w), 4).alias("mean_before"))


@plan("jn15_asof_price", """SELECT e.event_id, max(p.event_id) AS purchase_id FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts
  AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts < e.ts AND x.ts > p.ts) WHERE e.event_type = 'error' GROUP BY e.event_id""")
def asof_purchase(t: Tables):
    e = t.events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    p = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return asof_join(e, p, ["user_id"], "ts", "ts", ["purchase_id"], strict=True).select("event_id", "purchase_id")


@plan("jn16_interval_counts", """SELECT e.event_id, count(*) FILTER (x.ts > e.ts - INTERVAL 7 DAY) AS week, count(*) FILTER (x.ts > e.ts - INTERVAL 1 DAY) AS day FROM events e
  LEFT JOIN events x ON x.user_id = e.user_id AND x.event_type = 'error' AND x.ts > e.ts - INTERVAL 7 DAY AND x.ts <= e.ts WHERE e.event_type = 'signup' GROUP BY e.event_id""")
def interval_counts(t: Tables):
    # Counts of a trailing window need no join: one pass over each user's events in time order.
    at = F.col("ts").cast("timestamp").cast("double")
    e = t.events.withColumn("at", (at * 1_000_000).cast("long")).withColumn("err", F.when(F.col("event_type") == "error", 1))
    back = lambda days: F.count("err").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-(days * 86_400_000_000 - 1), 0))
    return e.withColumn("week", back(7)).withColumn("day", back(1)).where("event_type = 'signup'").select("event_id", "week", "day")


@plan("jn16_active_spans", """SELECT o.o_orderkey, count(*) AS active FROM orders o
  JOIN lineitem l ON l.l_suppkey = o.o_custkey % 100 JOIN orders s ON s.o_orderkey = l.l_orderkey WHERE s.o_orderdate < o.o_orderdate AND o.o_orderdate <= l.l_shipdate GROUP BY o.o_orderkey""")
def active_spans(t: Tables):
    points = t.orders.select("o_orderkey", (F.col("o_custkey") % 100).alias("k"), F.datediff("o_orderdate", F.lit("1970-01-01")).alias("at"))
    spans = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("begun")), "l_orderkey")
    spans = spans.select(F.col("l_suppkey").alias("k"), F.datediff("begun", F.lit("1970-01-01")).alias("s"), F.datediff("l_shipdate", F.lit("1970-01-01")).alias("e")).where("s < e")
    return bucketed_interval_join(points, spans, "k", "at", "s", "e", 90).groupBy("o_orderkey").agg(F.count("*").alias("active"))


@plan("jn17_forward", """SELECT e.event_id, CASE WHEN e.ts + INTERVAL 1 DAY > (SELECT max(ts) FROM events) THEN NULL
  ELSE EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.ts > e.ts AND x.ts <= e.ts + INTERVAL 1 DAY) END AS error_soon FROM events e WHERE e.event_type = 'view'""")
def forward(t: Tables):
    at = (F.col("ts").cast("timestamp").cast("double") * 1_000_000).cast("long")
    e = t.events.withColumn("at", at).withColumn("err", F.when(F.col("event_type") == "error", 1))
    ahead = F.count("err").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(1, 86_400_000_000))
    end = e.agg(F.max("at").alias("end"))
    e = e.withColumn("ahead", ahead).where("event_type = 'view'").join(F.broadcast(end))
    return e.select("event_id", F.when(F.col("at") + 86_400_000_000 <= F.col("end"), F.col("ahead") > 0).alias("error_soon"))


@plan("jn19_parent_lag", """WITH d AS (SELECT n_regionkey AS parent, c_nationkey AS site, o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
  p AS (SELECT parent, day, round(sum(v), 2) AS pv FROM d GROUP BY ALL), q AS (SELECT *, lag(pv) OVER (PARTITION BY parent ORDER BY day) AS prev FROM p)
  SELECT d.site, d.day::VARCHAR AS day, q.pv AS parent_v, q.prev AS parent_prev FROM d JOIN q USING (parent, day)""")
def parent_lag(t: Tables):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    d = j.groupBy(F.col("n_regionkey").alias("parent"), F.col("c_nationkey").alias("site"), F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    p = d.groupBy("parent", "day").agg(F.round(F.sum("v"), 2).alias("parent_v"))
    p = p.withColumn("parent_prev", F.lag("parent_v").over(Window.partitionBy("parent").orderBy("day")))
    return d.join(p, ["parent", "day"]).select("site", F.col("day").cast("string").alias("day"), "parent_v", "parent_prev")


@plan("jn20_neighbours", """WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
  SELECT a.event_id, b.event_id AS negative, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.rn - b.rn), b.rn) AS rank FROM o a JOIN o b ON a.user_id = b.user_id AND a.rn <> b.rn AND abs(a.rn - b.rn) <= 3 AND b.event_type <> a.event_type
  WHERE a.event_type = 'signup' QUALIFY rank <= 2""")
def neighbours(t: Tables):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    near = F.flatten(F.array(*(F.array(F.struct(F.lit(abs(k)).alias("d"), F.lit(k).alias("k"), F.lead("event_id", k).over(order).alias("negative"), F.lead("event_type", k).over(order).alias("kind"))) for k in (-3, -2, -1, 1, 2, 3))))
    e = t.events.withColumn("near", near).where("event_type = 'signup'")
    kept = F.filter("near", lambda x: x["negative"].isNotNull() & (x["kind"] != F.lit("signup")))
    return e.select("event_id", F.posexplode(F.slice(F.array_sort(kept), 1, 2)).alias("p", "x")).select("event_id", F.col("x.negative").alias("negative"), (F.col("p") + 1).cast("long").alias("rank"))


@plan("jn21_siblings", """WITH p AS (SELECT a.p_partkey, b.p_partkey AS sibling, CASE WHEN a.p_brand = b.p_brand AND a.p_type = b.p_type THEN 1 WHEN a.p_brand = b.p_brand THEN 2 ELSE 3 END AS scope
  FROM part a JOIN part b ON (a.p_brand = b.p_brand OR a.p_type = b.p_type) AND a.p_partkey <> b.p_partkey)
  SELECT p_partkey, sibling, scope FROM p QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY scope, sibling) <= 5""")
def siblings(t: Tables):
    return nearest_siblings(t.part, "p_partkey", "p_brand", "p_type", 5).select("p_partkey", "sibling", "scope")


@plan("jn24_version_ranges", """SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT p_partkey, p_size AS introduced, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size + 20 END AS ended, p_partkey % 2 = 0 AS inclusive FROM part)
  ON l_partkey = p_partkey AND l_quantity >= introduced AND (ended IS NULL OR l_quantity < ended OR (inclusive AND l_quantity = ended))""")
def version_ranges(t: Tables):
    r = t.part.select("p_partkey", F.col("p_size").alias("introduced"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") + 20).alias("ended"), (F.col("p_partkey") % 2 == 0).alias("inclusive"))
    q = F.col("l_quantity")
    inside = (q >= F.col("introduced")) & (F.col("ended").isNull() | (q < F.col("ended")) | (F.col("inclusive") & (q == F.col("ended"))))
    return t.lineitem.join(r, F.col("l_partkey") == F.col("p_partkey")).where(inside).select("l_orderkey", "l_linenumber")


@plan("jn25_climatology", """WITH s AS (SELECT o_custkey AS site, month(o_orderdate) AS m, count(*) FILTER (o_orderstatus = 'F') AS c, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT site, sum(c) / sum(n) AS prior FROM s GROUP BY site)
  SELECT s.site, s.m::INTEGER AS month, round((s.c + 10 * p.prior) / (s.n + 10), 6) AS rate FROM s JOIN p USING (site)""")
def climatology(t: Tables):
    s = t.orders.groupBy(F.col("o_custkey").alias("site"), F.month("o_orderdate").alias("month")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("c"), F.count("*").alias("n"))
    whole = Window.partitionBy("site")
    prior = F.sum("c").over(whole) / F.sum("n").over(whole)
    return s.select("site", "month", F.round((F.col("c") + 10 * prior) / (F.col("n") + 10), 6).alias("rate"))

