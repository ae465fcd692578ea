import duckdb
import pytest

from tessella import registry
from tessella.operators.components import connected_components
from tessella.operators.folds import suppressed
from tessella.operators.ranking import global_rank
from tessella.operators.timing import asof_join, damped

DATA = "/root/testdata/sf0.001"
SAMPLE = ["prj02_json_path", "jn06_run_diff", "jn16_interval_counts", "ag06_operation_stats", "wn02_flap_damping", "tx03_gopher_quality", "dd06_jaccard", "sp01_assign_split", "db09_lsm"]


def rows(df):
    return sorted(tuple("-" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in df)


@pytest.mark.parametrize("name", SAMPLE)
def test_plan_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels", "pages", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want)


def test_components_by_hand(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (None, 4), (3, 1), (10, 8)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 10: 7}


def test_components_of_a_long_path_and_of_nothing(spark):
    n = 300
    got = connected_components(spark.range(1, n).selectExpr("id a", "id - 1 b"), "a", "b")
    assert got.count() == n and got.where("component <> 0").count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_global_rank(spark):
    got = global_rank(spark.range(1000).selectExpr("999 - id as id"), ["id"]).collect()
    assert all(r.id == r.place for r in got) and len(got) == 1000


def test_asof_is_strict_or_not(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3)], "k string, t long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 2, "y")], "k string, t long, v string")
    loose = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "t", ["v"]).collect()}
    tight = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "t", ["v"], strict=True).collect()}
    assert loose == {("a", 5): "x", ("a", 1): None, ("b", 3): None} and tight == {("a", 5): "y", ("a", 1): None, ("b", 3): None}


def test_damping_by_fold(spark):
    obs = list("uudududdduu")
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(obs)], "k string, i int, s string")
    want, now = [], obs[0]
    for i, x in enumerate(obs):
        now = x if i == 0 or obs[i - 1] == x else now
        want.append(now)
    assert [r.confirmed for r in damped(df, ["k"], ["i"], "s", 2).orderBy("i").collect()] == want


def test_suppression_edge_holds(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 1, 10.0), (3, 1, 10.5), (4, 1, 21.0)], "id long, k long, at double")
    got = {r.id: r.fires for r in suppressed(df, "k", "at", "id", 10.0).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}
