"""How a plan gets its name and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load


class Tables:
    """The tables of a data folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` as the query ``name``; ``sql`` is what DuckDB runs to check it."""

    def register(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        PLANS[name] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return make

    return register
