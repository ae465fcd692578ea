"""Walks over graphs: subgraphs, dependents, strong components, communities, call stacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graphs import communities, stacks, strong_components, walk
from .base import Tables, plan

_E = "SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst FROM lineitem"
_BOTH = f"e AS ({_E}), f AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


def _edges(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("src"), (1_000_000 + F.col("l_partkey")).alias("dst")).distinct()


@plan("gr02_subgraph", f"WITH RECURSIVE {_BOTH}, r AS (SELECT 5::BIGINT AS node, 0 AS depth UNION SELECT f.dst, r.depth + 1 FROM r JOIN f ON f.src = r.node WHERE r.depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY node ORDER BY depth, node LIMIT 60")
def subgraph(t: Tables):
    """The 60 nearest nodes within two hops of a supplier, either way."""
    e = _edges(t)
    found = walk(e.union(e.select("dst", "src")), t.spark.sql("SELECT 5L AS node"), 2)
    return found.orderBy("depth", "node").limit(60)


@plan("gr05_blast_radius", "WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1), r AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_partkey IN (3, 40, 41) UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node")
def blast_radius(t: Tables):
    """What depends on changed nodes, up to three hops against the direction of the edges."""
    e = t.part.where("p_partkey > 1").select(F.floor(F.col("p_partkey") / 2).alias("src"), F.col("p_partkey").alias("dst"))
    return walk(e, t.part.where("p_partkey IN (3, 40, 41)").select(F.col("p_partkey").alias("node")), 3)


@plan("gr07_cycles", """WITH RECURSIVE e AS (SELECT DISTINCT p_partkey % 40 AS src, (p_partkey * 7 + p_size) % 40 AS dst FROM part WHERE p_size % 9 = 0 AND p_partkey % 5 < 2), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst),
  m AS (SELECT a.src AS node, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) SELECT node, least(node, min(other)) AS component FROM m GROUP BY node HAVING count(*) FILTER (other <> node) > 0""")
def cycles(t: Tables):
    """Strong components of more than one node."""
    e = t.part.where("p_size % 9 = 0 AND p_partkey % 5 < 2").select((F.col("p_partkey") % 40).alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 40).alias("dst"))
    found = strong_components(e)
    many = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(many, "component").select("node", "component")


@plan("gr08_communities")
def community_labels(t: Tables):
    """Label propagation over customers and parts, which meet in their nation and brand."""
    e = t.customer.select(F.col("c_custkey").alias("src"), (-1 - F.col("c_nationkey")).cast("long").alias("dst"))
    return communities(e, 4)


@plan("gr10_call_stacks", """WITH RECURSIVE s AS (SELECT l_orderkey AS trace, l_linenumber::BIGINT AS id, l_linenumber // 2 AS parent, min(l_returnflag) AS name, sum(l_quantity) AS ms FROM lineitem GROUP BY ALL),
  p AS (SELECT trace, id, name AS path FROM s WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.trace = s.trace AND x.id = s.parent) UNION ALL SELECT s.trace, s.id, p.path || '>' || s.name FROM p JOIN s ON s.trace = p.trace AND s.parent = p.id AND s.id <> p.id),
  k AS (SELECT trace, parent AS id, sum(ms) AS kids FROM s GROUP BY ALL) SELECT p.path, count(*) AS calls, sum(s.ms) AS total_ms, sum(greatest(s.ms - coalesce(k.kids, 0), 0)) AS self_ms, count(*) FILTER (s.ms < coalesce(k.kids, 0)) AS clamped
  FROM p JOIN s ON s.trace = p.trace AND s.id = p.id LEFT JOIN k ON k.trace = p.trace AND k.id = p.id GROUP BY p.path""")
def call_stacks(t: Tables):
    """Spans folded by the names from the root down; own time is what the direct children leave, at least nothing."""
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").cast("long").alias("id")).agg(F.min("l_returnflag").alias("name"), F.sum("l_quantity").alias("ms"))
    return stacks(s.withColumn("parent", F.floor(F.col("id") / 2)), 8)
