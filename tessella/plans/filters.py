"""Projections, filters, predicates, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import as_number, reasons
from .base import Tables, plan


@plan("prj01_predicates", "SELECT event_id, user_id FROM events WHERE value >= 100 AND contains(event_type, 'c') AND user_id IN (1, 2, 3, 5, 8) AND event_type <> 'view' AND value IS NOT NULL")
def predicates(t: Tables):
    e = t.events
    return e.where((e.value >= 100) & e.event_type.contains("c") & e.user_id.isin(1, 2, 3, 5, 8) & (e.event_type != "view") & e.value.isNotNull()).select("event_id", "user_id")


@plan("prj02_json_path", "SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.absent') IS NULL AS no_absent FROM events WHERE (props->>'$.k')::BIGINT >= 50")
def json_path(t: Tables):
    v = F.try_parse_json("props")
    return t.events.withColumn("k", F.try_variant_get(v, "$.k", "long")).where("k >= 50").select("event_id", "k", F.try_variant_get(v, "$.absent", "string").isNull().alias("no_absent"))


@plan("prj03_transform", "SELECT o_orderkey AS id, 'order ' || o_orderkey || ' is ' || o_orderstatus AS label, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, o_totalprice * 2 AS doubled FROM orders")
def transform(t: Tables):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.format_string("order %d is %s", "o_orderkey", "o_orderstatus").alias("label"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("pending")).alias("status"), (F.col("o_totalprice") * 2).alias("doubled"),
    )


_RANK = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END"


@plan("prj04_severity_floor", f"SELECT event_id, event_type FROM events WHERE {_RANK} <= 1 AND contains(lower(props), '7') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 200")
def severity_floor(t: Tables):
    ranks = F.create_map(*(F.lit(x) for kv in (("error", 0), ("purchase", 1), ("signup", 2), ("click", 3)) for x in kv))
    e = t.events.where(F.coalesce(F.try_element_at(ranks, "event_type"), F.lit(4)) <= 1).where(F.lower("props").contains("7"))
    return e.where("ts BETWEEN TIMESTAMP_NTZ '2024-01-05' AND TIMESTAMP_NTZ '2024-01-20'").orderBy("ts", "event_id").limit(200).select("event_id", "event_type")


@plan("prj05_span_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice >= 50000 AND l_returnflag = 'R' AND l_linestatus = 'F'")
def span_filter(t: Tables):
    wanted = {"l_returnflag": "R", "l_linestatus": "F", "l_shipmode": None}
    df = t.lineitem.where("l_extendedprice >= 50000")
    for name, value in wanted.items():
        df = df.where(F.col(name) == value) if value is not None else df
    return df.select("l_orderkey", "l_linenumber", "l_extendedprice")


@plan("prj06_section_reader", "SELECT o_orderkey AS id, o_orderdate AS at, o_totalprice AS amount FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def section_reader(t: Tables):
    roles = {"id": "o_orderkey", "at": "o_orderdate", "amount": "o_totalprice"}
    df = t.orders.where("o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP_NTZ '1998-01-01'")
    return df.select(*(F.col(c).alias(r) for r, c in roles.items())).orderBy(F.desc("at"), "id").limit(100)


@plan("prj08_source_filters", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE n_chars >= CASE WHEN lang = 'en' THEN 400 ELSE 200 END AND coalesce(l.quality >= 1, false)")
def source_filters(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.where(F.col("n_chars") >= F.when(F.col("lang") == "en", 400).otherwise(200)).where(F.coalesce(F.col("quality") >= 1, F.lit(False))).select("doc_id")


@plan("prj09_edu_gate", "SELECT d.doc_id, coalesce(l.quality >= 1, true) AS passes FROM documents d LEFT JOIN labels l USING (doc_id)")
def edu_gate(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality") >= 1, F.lit(True)).alias("passes"))


_LICENSES = "['cc-by-4.0', 'cc0-1.0', 'cc-by-nc-4.0', 'mit', 'cc-by-nd-4.0', 'unknown']"


@plan("prj10_license_gate", f"SELECT p_partkey, {_LICENSES}[(p_partkey % 6 + 1)::INT] AS license, {_LICENSES}[(p_partkey % 6 + 1)::INT] IN ('cc-by-4.0', 'cc0-1.0', 'mit', 'apache-2.0') AS allowed FROM part")
def license_gate(t: Tables):
    names = ["cc-by-4.0", "cc0-1.0", "cc-by-nc-4.0", "mit", "cc-by-nd-4.0", "unknown"]
    allow = F.array(*map(F.lit, ["cc-by-4.0", "cc0-1.0", "mit", "apache-2.0"]))
    df = t.part.select("p_partkey", F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int")).alias("license"))
    denied = F.arrays_overlap(F.split("license", "-"), F.array(F.lit("nc"), F.lit("nd")))
    return df.withColumn("allowed", F.array_contains(allow, F.col("license")) & ~denied)


@plan("prj11_path_glob", "SELECT page_id, url FROM pages WHERE lower(url) GLOB 'http*://*.example.com/*'")
def path_glob(t: Tables):
    return t.pages.where(F.lower("url").rlike(r"^http.*://.*\.example\.com/.*$")).select("page_id", "url")


@plan("prj12_retention", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'hold' WHEN o_orderkey % 11 = 0 THEN 'deleted'
  WHEN date_diff('day', o_orderdate, TIMESTAMP '2001-08-02') > 1000 THEN 'expired' ELSE 'kept' END AS verdict FROM orders""")
def retention(t: Tables):
    age = F.datediff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate"))
    return t.orders.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "hold").when(F.col("o_orderkey") % 11 == 0, "deleted").when(age > 1000, "expired").otherwise("kept").alias("verdict"))


@plan("prj13_eligibility", """SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END,
  CASE WHEN c_nationkey < 5 THEN 'nation' END) AS reasons FROM customer""")
def eligibility(t: Tables):
    c = t.customer
    named = reasons(("negative_balance", c.c_acctbal < 0), ("segment", c.c_mktsegment == "BUILDING"), ("nation", c.c_nationkey < 5))
    return c.select("c_custkey", F.array_join(named, ",").alias("reasons"))


_RAW = "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'NaN' WHEN 2 THEN 'n/a' WHEN 3 THEN 'abc' WHEN 4 THEN '-' ELSE p_retailprice::VARCHAR END"


@plan("prj14_as_number", f"SELECT p_partkey, CASE WHEN lower(trim(x)) NOT IN ('', 'none', 'null', 'nan', '-', 'na', 'n/a') THEN TRY_CAST(x AS DOUBLE) END AS number FROM (SELECT p_partkey, {_RAW} AS x FROM part)")
def numbers(t: Tables):
    raw = F.expr(_RAW.replace("p_retailprice::VARCHAR", "cast(p_retailprice as string)"))
    return t.part.select("p_partkey", as_number(raw).alias("number"))


@plan("prj15_event_key", "SELECT event_id, substr(sha256(event_type || '|' || user_id || '|' || strftime(ts, '%Y-%m-%d') || '|' || props), 1, 16) AS event_key FROM events")
def event_key(t: Tables):
    parts = F.concat_ws("|", "event_type", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), "props")
    return t.events.select("event_id", F.substring(F.sha2(parts, 256), 1, 16).alias("event_key"))


@plan("sr01_sort_limit", "SELECT c_custkey, round(c_acctbal, 2) AS score FROM customer ORDER BY round(c_acctbal, 2) DESC, c_custkey LIMIT 50")
def sort_limit(t: Tables):
    return t.customer.select("c_custkey", F.round("c_acctbal", 2).alias("score")).orderBy(F.desc("score"), "c_custkey").limit(50)


@plan("sr02_top_terms", """SELECT term, count(*) AS weight FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term ORDER BY weight DESC, term LIMIT 100""")
def top_terms(t: Tables):
    term = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("term")
    return t.documents.select(term).groupBy("term").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "term").limit(100)


@plan("sr03_facets", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def facets(t: Tables):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@plan("sr04_god_nodes", """SELECT node, count(*) AS degree FROM (SELECT 'c' || o_custkey AS node FROM orders UNION ALL SELECT 'o' || l_orderkey FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem)
  GROUP BY node ORDER BY degree DESC, node LIMIT 25""")
def god_nodes(t: Tables):
    ends = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("node")).union(t.lineitem.select(F.concat(F.lit("o"), "l_orderkey"))).union(t.lineitem.select(F.concat(F.lit("p"), "l_partkey")))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(25)


@plan("st01_intersect", "SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersect(t: Tables):
    return t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey")).intersect(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@plan("st01_union_any", "SELECT o_custkey AS custkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def union_any(t: Tables):
    return t.orders.where("o_orderpriority = '1-URGENT' OR o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey")).distinct()


@plan("st02_difference", """SELECT 'added' AS change, c_custkey AS custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
  UNION ALL SELECT 'removed', o_custkey FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def difference(t: Tables):
    c, o = t.customer, t.orders
    added = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.lit("added").alias("change"), F.col("c_custkey").alias("custkey")).distinct()
    rich = c.where("c_acctbal > 0")
    return added.union(o.join(rich, o.o_custkey == rich.c_custkey, "left_anti").select(F.lit("removed"), "o_custkey").distinct())


@plan("st03_line_sets", """SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber) FILTER (l_returnflag <> 'A')))::VARCHAR AS lines FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag <> 'A') > 0""")
def line_sets(t: Tables):
    lines = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_linenumber")))
    df = t.lineitem.groupBy("l_orderkey").agg(F.array_intersect(F.array_union(lines("R"), lines("N")), F.collect_set("l_linenumber")).alias("x"))
    return df.where(F.size("x") > 0).select("l_orderkey", F.concat(F.lit("["), F.array_join(F.array_sort("x"), ", "), F.lit("]")).alias("lines"))


@plan("st04_split_overlap", """WITH s AS (SELECT DISTINCT user_id, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP '2024-01-25' THEN 'dev' ELSE 'test' END AS split FROM events)
  SELECT a.split AS a, b.split AS b, count(*) AS shared FROM s a JOIN s b ON a.user_id = b.user_id AND a.split < b.split GROUP BY ALL""")
def split_overlap(t: Tables):
    split = F.expr("CASE WHEN ts < TIMESTAMP_NTZ '2024-01-20' THEN 'train' WHEN ts < TIMESTAMP_NTZ '2024-01-25' THEN 'dev' ELSE 'test' END")
    sets = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set(split)).alias("splits"))
    pairs = sets.select(F.explode("splits").alias("a"), "splits").select("a", F.explode("splits").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


@plan("st05_merged_dedupe", "SELECT o_custkey, max(o_orderdate) AS newest, count(*) - 1 AS duplicates FROM orders GROUP BY o_custkey")
def merged_dedupe(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"), (F.count("*") - 1).alias("duplicates"))


@plan("ud03_schema_gate", "SELECT event_id FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND event_type IN ('click', 'view', 'purchase', 'signup') AND value IS NOT NULL AND props IS NOT NULL")
def schema_gate(t: Tables):
    e = t.events.na.drop(subset=["event_id", "ts", "user_id", "value", "props"])
    return e.where(F.col("event_type").isin("click", "view", "purchase", "signup")).select("event_id")


@plan("src03_project_where_limit", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 ORDER BY s_suppkey LIMIT 40")
def project_where_limit(t: Tables):
    return t.supplier.where("s_acctbal > 0").orderBy("s_suppkey").limit(40).select("s_suppkey", "s_name")


@plan("snk07_ordered_chunks", "SELECT page_id, ((row_number() OVER (ORDER BY page_id) - 1) // 50)::BIGINT AS chunk FROM pages")
def ordered_chunks(t: Tables):
    from ..operators.ranking import global_rank

    return global_rank(t.pages.select("page_id"), ["page_id"]).select("page_id", F.floor(F.col("place") / 50).alias("chunk"))

