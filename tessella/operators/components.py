"""Connected components of an edge list, by contraction, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut

#: Rounds after which a run is taken for broken; each round at least halves what can still be merged.
MAX_ROUNDS = 60


def _jump(parents: DataFrame) -> DataFrame:
    """One pointer jump: every node points to its parent's parent."""
    up = parents.select(F.col("node").alias("p"), F.col("parent").alias("pp"))
    return (
        parents.join(up, parents["parent"] == up["p"], "left")
        .select("node", F.coalesce("pp", "parent").alias("parent"))
    )


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Each round every remaining super-node hooks to its smallest neighbour, pointers are jumped until they rest on roots,
    and the edges are rewritten between roots. Hooking aggregates with a plain ``min``, so a hub node is combined before
    the shuffle; lookups join two written tables, so adaptive execution can split a hub there. Null ends and self loops
    are ignored; repeated edges don't matter; an empty edge list gives no rows.
    """
    live = cut(
        edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a < b").distinct(),
        "cc-edges",
    )
    labels = None
    for _ in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        hooks = live.select(F.col("b").alias("node"), F.col("a").alias("near")).union(
            live.select(F.col("a").alias("node"), F.col("b").alias("near"))
        )
        parents = cut(hooks.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("parent")), "cc-hook")
        while True:
            jumped = cut(_jump(_jump(parents)), "cc-jump")
            moved = jumped.join(parents, "node").where(jumped["parent"] != parents["parent"])
            done = moved.isEmpty()
            parents = jumped
            if done:
                break
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("p"), F.col("parent").alias("pp"))
            labels = cut(labels.join(up, labels["parent"] == up["p"], "left").select("node", F.coalesce("pp", "parent").alias("parent")), "cc-labels")
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        live = cut(
            live.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "cc-edges",
        )
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("parent").alias("component"))
