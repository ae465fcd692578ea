"""Ranks and prefix sums over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut, shuffle_width


def global_rank(df: DataFrame, keys: list) -> DataFrame:
    """``df`` with ``place``, the rank from 0 in the order of ``keys`` (which should tell all rows apart).

    Rows are sorted by range and written; a range's rows are counted, and the counts before it (one number a range) make
    the ranks global.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    numbered = cut(ordered.withColumn("_row", F.monotonically_increasing_id()), "ranked")
    counts = numbered.groupBy(F.shiftright("_row", 33).alias("r")).count().orderBy("r").collect()
    starts, before = [], 0
    for r, n in counts:
        starts.append((r, before))
        before += n
    offsets = spark.createDataFrame(starts, "_r long, _start long")
    joined = numbered.withColumn("_r", F.shiftright("_row", 33)).join(F.broadcast(offsets), "_r")
    return joined.withColumn("place", F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_r", "_row", "_start")


def running_sum(df: DataFrame, keys: list, amount: str, block: int = 65_536) -> DataFrame:
    """``df`` with ``before``, the sum of ``amount`` over the rows before it in the order of ``keys``: sums of blocks of
    ranks first, then inside each block."""
    ranked = global_rank(df, keys).withColumn("_block", F.floor(F.col("place") / block))
    sums = ranked.groupBy("_block").agg(F.sum(amount).alias("_m"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_block", F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("_inner", F.coalesce(F.sum(amount).over(inner), F.lit(0))).join(sums, "_block")
    return placed.withColumn("before", F.col("_start") + F.col("_inner")).drop("_block", "_inner", "_start", "place")
