"""Nearest rows against the SQL on tables with copies, shared ids, zero, null and non-finite vectors."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella import registry
from tessella.operators import nearest

NAMES = ["dd21_dense_top", "dd22_exact_l2", "dd27_truncated"]


def table(path, rows):
    ids, vectors = zip(*rows, strict=True)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}), f"{path}/embeddings.parquet")


def shown(rows):
    return sorted(tuple("-" if x is None else repr(float(x)) for x in r) for r in rows)


def same(spark, path, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    columns = "query_id, vec_id" + ", score" * (name != "dd22_exact_l2")
    want = c.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()
    got = registry.queries()[name](spark, str(path))
    assert shown(map(tuple, got.select(*columns.split(", ")).collect())) == shown(want) and want


def drawn(n, draw):
    rows = [[draw.gauss(0, 1) for _ in range(64)] for _ in range(n)]
    rows[n // 2 :] = [rows[draw.randrange(9)] if draw.random() < 0.6 else [x + draw.choice([0, 1e-6]) for x in rows[draw.randrange(9)]] for _ in rows[n // 2 :]]
    return rows


@pytest.mark.parametrize("name", NAMES)
def test_nearest_equal_the_sql(spark, tmp_path, name, monkeypatch):
    """Copies and near copies, whose scores tie once rounded, over several blocks; ids that two rows share."""
    draw = random.Random(7)
    table(tmp_path, [(draw.randrange(250) if k % 50 == 7 else k, x) for k, x in enumerate(drawn(300, draw))])
    for block, queries, some in ((65_536, 256, 4_096), (7, 2, 11)):
        for k, n in (("BLOCK", block), ("QUERIES", queries), ("ROWS", some)):
            monkeypatch.setattr(nearest, k, n)
        same(spark, tmp_path, name)


@pytest.mark.parametrize("name", NAMES)
def test_odd_vectors_rank_as_in_the_sql(spark, tmp_path, name):
    draw = random.Random(8)
    odd = {0: None, 3: None, 5: [0.0] * 64, 20: [0.0] * 64, 21: [float("nan")] * 64, 40: [float("inf")] + [1.0] * 63, 41: [float("-inf")] + [1.0] * 63, 60: [float("nan")] + [0.5] * 63}
    table(tmp_path, [(k, odd.get(k, x)) for k, x in enumerate(drawn(70, draw))])
    same(spark, tmp_path, name)
    table(tmp_path, [(k, odd.get(k, [1.0] * 64)) for k in (0, 3, 5, 8, 40)])
    same(spark, tmp_path, name)


def test_a_table_of_40_000_rows_is_a_matter_of_seconds(spark, tmp_path):
    rows = np.random.default_rng(3).normal(size=(40_000, 64)).astype("float32")
    table(tmp_path, list(enumerate(rows)))
    began = time.time()
    assert registry.queries()["dd22_exact_l2"](spark, str(tmp_path)).count() == 6_000
    assert time.time() - began < 60
