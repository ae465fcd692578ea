"""Graph operators as joins of edge and node tables; lineage is cut every round, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

#: Rounds after which a run is taken for broken.
MAX_ROUNDS = 200


def walk(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, depth) of all nodes within ``hops`` of ``start`` (node) along ``edges`` (src, dst), breadth first."""
    seen = start.select("node", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, hops + 1):
        near = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(near.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "walk")
        seen = seen.union(frontier)
    return seen


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node takes the least label that reaches it along ``edges``, round by round until none moves."""
    for _ in range(MAX_ROUNDS):
        sent = edges.join(labels, F.col("src") == F.col("node")).select(F.col("dst").alias("to"), "label").groupBy("to").agg(F.min("label").alias("sent"))
        moved = labels.join(sent, F.col("node") == F.col("to"), "left").select("node", F.least("label", F.coalesce("sent", "label")).alias("label"), (F.col("sent") < F.col("label")).alias("moved"))
        moved = cut(moved, "spread")
        labels = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; component is the least node of its strong component.

    Colouring: the least node that reaches a node is its colour; of each colour the nodes that reach the colour's own node
    along edges inside the colour are one component. They leave, and the rest is coloured again.
    """
    live = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "scc-edges")
    nodes = cut(live.select(F.col("src").alias("node")).union(live.select("dst")).distinct(), "scc-nodes")
    done = None
    for _ in range(MAX_ROUNDS):
        if nodes.isEmpty():
            break
        coloured = _spread(nodes.withColumn("label", F.col("node")), live)
        a, b = coloured.select(F.col("node").alias("src"), F.col("label").alias("ca")), coloured.select(F.col("node").alias("dst"), F.col("label").alias("cb"))
        back = cut(live.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-back")
        # Against the edges the colour's own node reaches exactly its component: it sends its label, others send none.
        far = F.when(F.col("node") == F.col("label"), F.col("label")).otherwise(F.lit((1 << 63) - 1))
        reached = _spread(coloured.select("node", far.alias("label")), back)
        found = cut(reached.join(coloured.withColumnRenamed("label", "colour"), "node").where("label = colour").select("node", F.col("colour").alias("component")), "scc-found")
        done = found if done is None else cut(done.union(found), "scc-done")
        nodes = cut(nodes.join(found, "node", "left_anti"), "scc-nodes")
        live = cut(live.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "scc-edges")
    else:
        raise RuntimeError("components did not settle")
    return done if done is not None else nodes.withColumn("component", F.col("node"))


def communities(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, community) by label propagation: each round every node takes the label that most of its neighbours have, ties
    to the least; neighbours' labels are counted before they are compared, so a hub is combined early."""
    both = cut(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "lpa-edges")
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels, F.col("src") == F.col("node")).groupBy("dst", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("community"))
        labels = cut(best.select(F.col("dst").alias("node"), "community"), "lpa")
    return labels


def stacks(spans: DataFrame, depth: int) -> DataFrame:
    """path, calls, total_ms, self_ms and clamped of spans (trace, id, parent, name, ms) folded by their stack. A span whose
    parent is missing is a root; spans below ``depth`` levels or on a cycle have no stack and are left out."""
    ids = spans.select(F.col("trace").alias("t"), F.col("id").alias("i"))
    roots = spans.join(ids, (F.col("trace") == F.col("t")) & (F.col("parent") == F.col("i")), "left_anti")
    level = roots.select("trace", "id", F.col("name").alias("path"))
    found = level
    for _ in range(depth - 1):
        up = level.select(F.col("trace").alias("t"), F.col("id").alias("p"), F.col("path").alias("above"))
        level = cut(spans.join(up, (F.col("trace") == F.col("t")) & (F.col("parent") == F.col("p"))).where("id <> p").select("trace", "id", F.concat_ws(">", "above", "name").alias("path")), "stacks")
        if level.isEmpty():
            break
        found = found.union(level)
    kids = spans.groupBy("trace", F.col("parent").alias("id")).agg(F.sum("ms").alias("kids"))
    each = found.join(spans.select("trace", "id", "ms"), ["trace", "id"]).join(kids, ["trace", "id"], "left").withColumn("own", F.col("ms") - F.coalesce("kids", F.lit(0.0)))
    return each.groupBy("path").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.sum(F.greatest("own", F.lit(0.0))).alias("self_ms"), F.count_if(F.col("own") < 0).alias("clamped"))


def nearest(candidates: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first ``most`` candidates of each key."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
