"""Ordered operators: as-of and interval joins, sessions, damping, incidents, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a timestamp with or without zone."""
    return F.unix_timestamp(ts.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, values: list[str], strict: bool = False) -> DataFrame:
    """The latest row of ``right`` not after each row of ``left`` (strictly before with ``strict``), by ``keys``.

    Both sides are stacked and read once in time order, so the cost is one shuffle by key and a sort, never a range join.
    Rows of ``right`` at one time are told apart by their values, the largest wins.
    """
    payload = F.struct(right_on, *values)
    no = F.lit(None)
    a = left.select(*left.columns, F.col(left_on).alias("_t"), F.lit(0 if strict else 1).alias("_o"), no.cast(right.select(payload.alias("p")).dtypes[0][1]).alias("_p"))
    b = right.select(*(F.col(k) if k in keys else no.cast(t).alias(k) for k, t in left.dtypes), F.col(right_on).alias("_t"), F.lit(1 if strict else 0).alias("_o"), payload.alias("_p"))
    order = Window.partitionBy(*keys).orderBy("_t", "_o", "_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stacked = a.unionByName(b).withColumn("_last", F.last("_p", ignorenulls=True).over(order))
    return stacked.where("_p is null").select(*left.columns, *(F.col(f"_last.{v}").alias(v) for v in values), F.col(f"_last.{right_on}").alias(f"matched_{right_on}"))


def bucketed_interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of a point and a span of the same key with ``start < at <= end`` (numbers). Spans are laid over buckets of
    ``width``, so the join is an equi-join on key and bucket."""
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [key, "_b"]).where(F.col(at) > F.col(start)).where(F.col(at) <= F.col(end)).drop("_b")


def sessions(events: DataFrame, keys: list[str], ts: str, gap: float, tie: str) -> DataFrame:
    """``events`` with ``session_no`` from 0: a new one where the time since the event before is over ``gap`` seconds."""
    order = Window.partitionBy(*keys).orderBy(ts, tie)
    since = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(order)
    return events.withColumn("session_no", F.sum(F.when(since > gap, 1).otherwise(0)).over(order))


def damped(events: DataFrame, keys: list[str], order_by: list[str], state: str, depth: int) -> DataFrame:
    """``confirmed``: the state after ``depth`` equal observations in a row, else the one confirmed before; the first
    observation confirms itself."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    change = F.when(F.col(state).eqNullSafe(F.lag(state).over(order)), 0).otherwise(1)
    runs = events.withColumn("_run", F.sum(change).over(order)).withColumn("_n", F.row_number().over(order))
    runs = runs.withColumn("_len", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order_by)))
    sure = F.when((F.col("_len") >= depth) | (F.col("_n") == 1), F.col(state))
    return runs.withColumn("confirmed", F.last(sure, ignorenulls=True).over(order)).drop("_run", "_n", "_len")


def islands(events: DataFrame, keys: list[str], order_by: list[str], state: str) -> DataFrame:
    """``island``: the number of the run of equal states a row belongs to, from 1."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    return events.withColumn("island", F.sum(F.when(F.col(state).eqNullSafe(F.lag(state).over(order)), 0).otherwise(1)).over(order))
