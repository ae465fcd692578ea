"""Graph queries over the customer, order and part edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.components import connected_components
from .base import Tables, plan


@plan("gr03_components", "WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, n_regionkey + 100 AS b FROM nation), f AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM f UNION SELECT f.b, r.root FROM r JOIN f ON f.a = r.node) SELECT node::BIGINT AS node, min(root)::BIGINT AS component FROM r GROUP BY node")
def components(t: Tables):
    e = t.nation.select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") + 100).cast("long").alias("b"))
    return connected_components(e, "a", "b")


_EDGES = "SELECT DISTINCT l_suppkey AS src, 1000 + l_partkey AS dst FROM lineitem"


@plan("gr04_impact", f"WITH RECURSIVE e AS ({_EDGES}), f AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT 7::BIGINT AS node, 0 AS depth UNION SELECT f.dst, r.depth + 1 FROM r JOIN f ON f.src = r.node WHERE r.depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def impact(t: Tables):
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), (1000 + F.col("l_partkey")).alias("dst")).distinct()
    both = e.union(e.select("dst", "src"))
    seen = t.spark.range(1).select(F.lit(7).cast("long").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, 5):  # a bounded walk: one join a hop
        frontier = frontier.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.union(frontier)
    return seen


@plan("gr06_fan_in", "SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS fan_in FROM lineitem GROUP BY ALL ORDER BY fan_in DESC, node LIMIT 50")
def fan_in(t: Tables):
    return t.lineitem.groupBy(F.col("l_partkey").alias("node")).agg(F.count_distinct("l_orderkey").alias("fan_in")).orderBy(F.desc("fan_in"), "node").limit(50)


@plan("gr09_surprise_edges", "SELECT l_orderkey, l_linenumber, l_partkey, (c_nationkey <> s_nationkey)::INT * 2 + (p_size > 25)::INT AS surprise FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE (c_nationkey <> s_nationkey)::INT * 2 + (p_size > 25)::INT >= 3")
def surprise_edges(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    score = (F.col("c_nationkey") != F.col("s_nationkey")).cast("int") * 2 + (F.col("p_size") > 25).cast("int")
    return j.withColumn("surprise", score).where("surprise >= 3").select("l_orderkey", "l_linenumber", "l_partkey", "surprise")


@plan("gr12_community_summary", "SELECT n_regionkey AS community, count(*) AS size, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def community_summary(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("community")).agg(F.count("*").alias("size"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
