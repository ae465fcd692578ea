"""Exact nearest rows of every query by blocked matrix products.

Rows and queries are dealt into blocks, and each block of queries meets each block of rows once. A product only tells which pairs
may be among the best: those that come within the rounding of the last one kept. These are scored again component by component,
in doubles and in order, and rounded as SQL rounds, so the ranks don't depend on the order of sums in a product.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shuffle_width

#: Rows and queries of a block at most; rows of a small table that are worth a block; queries and rows of one product.
BLOCK, LEAST, QUERIES, ROWS = 65_536, 2_048, 256, 4_096
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, summed in order."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero on the scaled double, as SQL does."""
    y = np.abs(x * 10.0**digits)
    whole = np.floor(y)
    r = np.copysign(whole + (y - whole >= 0.5), x) / 10.0**digits
    return np.where(np.isfinite(r), r, x)


def _cosine(q: np.ndarray, v: np.ndarray, qq: np.ndarray, vv: np.ndarray) -> np.ndarray:
    return _dot(q, v) / np.sqrt(qq) / np.sqrt(vv)


def _l2(q: np.ndarray, v: np.ndarray, qq: np.ndarray, vv: np.ndarray) -> np.ndarray:
    return qq + vv - 2 * _dot(q, v)


def _fewer_copies(v: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """The rows without those of equal vectors that have over ``top`` smaller ids before them: a query leaves out one id at most."""
    if not v.shape[1]:
        same = np.zeros(len(v), int)
    else:
        same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    first = np.append(True, s[1:] != s[:-1])
    step = np.cumsum(np.append(True, i[1:] != i[:-1]) | first)
    place = step - np.maximum.accumulate(np.where(first, step, 0))
    return np.sort(order[place <= top])


def _solve(top: int, cosine: bool, digits: int) -> Callable:
    unit, many, wide = 10.0**-digits, QUERIES, ROWS

    def ranked(q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The order of pairs by query, score and id; NaN is above all numbers."""
        odd = np.isnan(score)
        return np.lexsort((ids, np.where(odd, 0, -score if cosine else score), ~odd if cosine else odd, q))

    def kept(q: np.ndarray) -> np.ndarray:
        """The first ``top`` of each query in sorted ``q``."""
        return np.arange(len(q)) - np.searchsorted(q, q) < top

    def solve(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        dim = key[0].as_py()
        ids, own = data.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        v, q = _matrix(data.column("v"), dim), _matrix(queries.column("q"), dim)
        use = _fewer_copies(v, ids, top)
        ids, v = ids[use], v[use]
        vv, qq = _dot(v, v), _dot(q, q)
        size = np.sqrt(vv) if cosine else 1.0
        near = v / np.reshape(size, (-1, 1))
        out = []
        for a in range(0, len(own), many):
            part, mine, norm = q[a : a + many], own[a : a + many], qq[a : a + many]
            asked = part / np.sqrt(norm)[:, None] if cosine else part
            floor = np.full(len(part), -np.inf)
            pool = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            for b in range(0, len(ids), wide):
                s = asked @ near[b : b + wide].T
                if not cosine:
                    s = 2 * s - norm[:, None] - vv[None, b : b + wide]
                s = np.where(np.isnan(s), np.inf if cosine else -np.inf, s)
                if b == 0 and s.shape[1] > top:
                    s[mine[:, None] == ids[:wide]] = -np.inf
                    floor = np.partition(s, -top, axis=1)[:, -top]
                    floor = floor - unit - 1e-12 * np.abs(floor) - (0 if cosine else 1e-12 * (norm + vv.max()))
                    floor[np.isnan(floor)] = -np.inf
                i, j = np.nonzero(s >= floor[:, None])
                fresh = mine[i] != ids[b + j]
                i, j = i[fresh], j[fresh]
                if not len(i):
                    continue
                pool = np.append(pool[0], i), np.append(pool[1], b + j), np.append(pool[2], s[i, j])
                order = np.lexsort((-pool[2], pool[0]))
                pool = tuple(x[order] for x in pool)
                start = np.searchsorted(pool[0], np.arange(len(part)))
                full = np.searchsorted(pool[0], np.arange(len(part)), "right") - start >= top
                last = pool[2][np.where(full, start + top - 1, 0)]
                slack = unit + 1e-12 * np.abs(last) + (0 if cosine else 1e-12 * (norm + vv.max()))
                now = np.where(full, last - slack, -np.inf)
                floor = np.maximum(floor, np.where(np.isnan(now), -np.inf, now))
                stay = pool[2] >= floor[pool[0]]
                pool = tuple(x[stay] for x in pool)
            measure = _cosine if cosine else _l2
            exact = [measure(part[i], v[j], norm[i], vv[j]) for i, j in ((pool[0][c : c + BLOCK], pool[1][c : c + BLOCK]) for c in range(0, len(pool[0]), BLOCK))]
            score = _rounded(np.concatenate(exact) if exact else np.zeros(0), digits)
            order = ranked(mine[pool[0]], score, ids[pool[1]])
            order = order[kept(mine[pool[0]][order])]
            out.append(pa.Table.from_arrays([pa.array(mine[pool[0][order]]), pa.array(ids[pool[1][order]]), pa.array(score[order])], schema=FOUND))
        return pa.concat_tables(out)

    def quietly(key: tuple, data: pa.Table, queries: pa.Table) -> pa.Table:
        with np.errstate(all="ignore"):  # zero and non-finite vectors give NaN
            return solve(key, data, queries)

    return quietly


def nearest_rows(vectors: DataFrame, queries: DataFrame, top: int, measure: str, digits: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the ``top`` rows (vec_id, v) with the highest cosine to (``measure`` "cosine"), or of
    least squared distance from ("l2"), every query (query_id, q), by the score rounded to ``digits``, then the id.

    Rows with the query's id are left out. NaN is above all numbers. Scores with a null vector, a null component or a vector of
    another length are null and come last.
    """
    spark, cosine = vectors.sparkSession, measure == "cosine"
    length = lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), F.size(c)).otherwise(F.lit(-1))
    v = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "v", length(F.col("v")).alias("d"))
    q = queries.where("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "q", length(F.col("q")).alias("d"))
    n, m = v.count(), q.count()
    rows, parts = max(1, ceil(n / BLOCK), min(shuffle_width(spark), ceil(n / LEAST))), max(1, ceil(m / BLOCK))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    data = v.where("d >= 0").select("vec_id", "v", "d", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int").alias("block"), each(parts).alias("part"))
    asked = q.where("d >= 0").select("query_id", "q", "d", each(rows).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"))
    keys = ["d", "block", "part"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_solve(top, cosine, digits), "query_id long, vec_id long, score double")
    least = v.withColumn("r", F.dense_rank().over(Window.partitionBy("d").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    least = least.withColumn("r", F.row_number().over(Window.partitionBy("d", "vec_id").orderBy("d"))).where(F.col("r") <= top).select("vec_id", F.col("d").alias("e"))
    unlike = (F.col("query_id") != F.col("vec_id")) & ((F.col("d") < 0) | (F.col("d") != F.col("e")))
    bare = q.select("query_id", "d").join(least, unlike).select("query_id", "vec_id", F.lit(None).cast("double").alias("score"))
    best: Column = F.desc_nulls_last("score") if cosine else F.asc_nulls_last("score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(best, "vec_id"))
    return found.unionByName(bare).withColumn("rank", rank).where(F.col("rank") <= top)
