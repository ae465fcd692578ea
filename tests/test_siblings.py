"""Siblings against the SQL on tables with nulls, repeated keys and one large group."""

import random

import duckdb

from tessella import registry
from tessella.operators.siblings import nearest_siblings


def wanted(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE part (p_partkey BIGINT, p_brand VARCHAR, p_type VARCHAR)")
    c.executemany("INSERT INTO part VALUES (?, ?, ?)", rows)
    return sorted(c.execute(f"SELECT p_partkey, sibling, scope FROM ({registry.oracle_sql()['jn21_siblings']})").fetchall())


def test_siblings_equal_the_sql_on_odd_rows(spark):
    draw = random.Random(5)
    for brands, types, keys, n in ((3, 2, 400, 120), (2, 9, 25, 80), (40, 3, 400, 120), (1, 1, 9, 30)):
        rows = [(draw.choice([None, *range(keys)] if keys < 400 else range(keys)), draw.choice([None, *"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMN"[:brands]]), draw.choice([None, *"tuvwxyzab"[:types]])) for _ in range(n)]
        df = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string")
        assert sorted(map(tuple, nearest_siblings(df, "p_partkey", "p_brand", "p_type", 5).collect())) == wanted(rows)


def test_a_group_does_not_meet_itself(spark, tmp_path):
    """60,000 rows of one brand and type would be 3.6 billion pairs."""
    spark.sql("SELECT id AS p_partkey, 'b' AS p_brand, 't' AS p_type FROM range(60000)").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["jn21_siblings"](spark, str(tmp_path))
    assert got.count() == 300_000
    assert sorted(r.sibling for r in got.where("p_partkey = 3").collect()) == [0, 1, 2, 4, 5]
