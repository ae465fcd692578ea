"""The first members of a row's groups, without a join of the groups with themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut


def nearest_siblings(df: DataFrame, key: str, one: str, two: str, top: int) -> DataFrame:
    """(key, sibling, scope) of the ``top`` other rows by scope and key: 1 if both columns are equal, 2 if only ``one`` is,
    3 if only ``two`` is; null equals nothing. Rows that share a key aren't siblings, and share one list.

    A row loses only its own key, so the ``top + 1`` least keys of each group hold its siblings. Across the groups of a ``one``
    (or ``two``) twice as many do, since leaving one group out takes ``top + 1`` of them at most. So a list is made for each
    pair of values that occurs, and the rows only meet the list of their pair.
    """
    rows = df.select(F.col(key).alias("k"), F.col(one).alias("a"), F.col(two).alias("b")).where("k IS NOT NULL")
    least = Window.partitionBy("a", "b").orderBy("k")
    ends = cut(rows.withColumn("r", F.dense_rank().over(least)).where(F.col("r") <= top + 1).groupBy("a", "b", "k").agg(F.count("*").alias("n")), "siblings-ends")
    pairs = ends.select("a", "b").distinct()

    def across(same: str, other: str, scope: int) -> DataFrame:
        w = Window.partitionBy(same).orderBy("k")
        of_key = Window.partitionBy(same, "k").orderBy(other)
        least = ends.where(F.col(same).isNotNull()).withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= 2 * (top + 1))
        least = least.withColumn("r", F.row_number().over(of_key)).where(F.col("r") <= top + 1)  # a key may be in many groups
        found = pairs.join(least.select(same, F.col(other).alias("o"), "k", "n"), same).where(~F.coalesce(F.col("o") == F.col(other), F.lit(False)))
        return found.groupBy("a", "b", "k").agg(F.sum("n").alias("n")).select("a", "b", F.lit(scope).alias("scope"), "k", "n")

    both = ends.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b", F.lit(1).alias("scope"), "k", "n")
    every = both.unionByName(across("a", "b", 2)).unionByName(across("b", "a", 3))
    first = Window.partitionBy("a", "b").orderBy("scope", "k")
    kept = every.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top + 3)  # a key is once in each scope
    lists = kept.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.array_sort(F.collect_list(F.struct("scope", "k", F.least("n", F.lit(top)).cast("int").alias("n")))).alias("s"))
    lists = cut(lists, "siblings-lists")
    others = F.filter("s", lambda x: x["k"] != F.col("k"))
    own = F.flatten(F.transform(others, lambda x: F.array_repeat(F.struct(x["scope"].alias("scope"), x["k"].alias("sibling")), x["n"])))
    met = rows.join(lists, F.col("a").eqNullSafe(F.col("x")) & F.col("b").eqNullSafe(F.col("y"))).select("k", F.slice(own, 1, top).alias("s"))
    lists = met.groupBy("k").agg(F.slice(F.array_sort(F.flatten(F.collect_list("s"))), 1, top).alias("s"))
    return lists.select(F.col("k").alias(key), F.explode("s").alias("x")).select(key, "x.sibling", "x.scope")
