"""Exact top-k by inner product as a Voronoi join.

Vectors are grouped by their nearest pivot. A group's summary is its radius, its longest vector and its number of rows. A
query first meets its own group and so gets a score that its k-th result reaches at least. A vector v of a group with pivot p
and radius r scores no more than q.p + |q| r (Cauchy-Schwarz), and no more than (|q|^2 + max |v|^2 - d^2) / 2 with d = max(0,
|q - p| - r), its least distance from q (triangle inequality). The query is copied only to the groups whose lower bound reaches
its score, and a group's rows only as often as there are batches of queries that visit it; groups that no query visits go
nowhere. Groups are solved by matrix products, large ones in blocks, and the best k of all groups are kept. Vectors of
different lengths never meet: each length is searched by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

#: Rows that pivots are fitted on, at most, taken by the hash of their id; rounds of fitting; pivots at most (they and their
#: summaries are held by every worker). Up to there the number of pivots is the root of the number of rows.
SAMPLE, ROUNDS, PIVOTS = 16_384, 4, 2_048
#: Rows of a group that are solved together, and queries that meet them at a time.
BLOCK, QUERY_BLOCK = 2_048, 16_384
#: Slack of the bounds against the rounding of doubles, relative to their size.
SLACK = 1e-9
PLACED = "vec_id long, v array<double>, cell int, radius double"
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component as a double; null if the vector is null or holds a null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double")))


def fit_pivots(points: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Pivots of a sample: evenly spaced rows of it, moved to the means of their groups."""
    pivots = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)] if len(points) else np.zeros((0, 0))
    for _ in range(rounds):
        if not len(pivots):
            break
        cell = nearest(points, pivots)[0]
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, points)
        n = np.bincount(cell, minlength=len(pivots))
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    return pivots


def nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each point and its distance."""
    cell = np.argmin((pivots**2).sum(1) - 2 * points @ pivots.T, axis=1)
    return cell, np.sqrt(((points - pivots[cell]) ** 2).sum(1))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _place(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, radius = nearest(_matrix(batch.column("v")), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(radius)], names=["vec_id", "v", "cell", "radius"])

    return run


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of every row, ties to the smaller id."""
    if scores.shape[1] > 4 * k:  # all that reach the k-th score, ties included
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        near = scores >= edge
        width = int(near.sum(1).max())
        if width < scores.shape[1]:
            order = np.argsort(~near, axis=1, kind="stable")[:, :width]
            part = np.take_along_axis(np.where(near, scores, -np.inf), order, 1)
            rank = np.lexsort((ids[order], -part), axis=1)[:, :k]
            return np.take_along_axis(order, rank, 1)
    return np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]


_NO_ID = np.iinfo(np.int64).max


def _solve(k: int):
    def solve(data: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not data.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids = data.column("vec_id").combine_chunks().fill_null(_NO_ID).to_numpy()
        vectors = _matrix(data.column("v").combine_chunks())
        out = []
        for at in range(0, queries.num_rows, 256):
            part = queries.slice(at, 256)
            own = part.column("query_id").to_numpy()
            scores = _matrix(part.column("q").combine_chunks()) @ vectors.T
            scores[own[:, None] == ids] = -np.inf
            top = best(scores, ids, k)
            score = np.take_along_axis(scores, top, 1)
            real = np.isfinite(score)
            found = np.broadcast_to(own[:, None], top.shape)[real], ids[top][real], score[real].astype(np.int64)
            out.append(pa.Table.from_arrays([pa.array(found[0]), pa.array(found[1], mask=found[1] == _NO_ID), pa.array(found[2])], schema=schema))
        return pa.concat_tables(out)

    return solve


def reach(q: np.ndarray, pivots: np.ndarray, radii: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """An upper bound of the score of each query with any vector of each group."""
    dot, norm = q @ pivots.T, (q**2).sum(1)[:, None]
    apart = np.sqrt(np.maximum(norm + (pivots**2).sum(1) - 2 * dot, 0)) - radii
    return np.minimum(dot + np.sqrt(norm) * radii, (norm + longest - np.maximum(apart * (1 - SLACK), 0) ** 2) / 2)


def _visits(pivots: np.ndarray, radii: np.ndarray, longest: np.ndarray):
    """Rows (query_id, q, visit) for every other group that a query must meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_024):
                batch = whole.slice(at, 1_024)
                q = _matrix(batch.column("q"))
                floor = batch.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                bound = reach(q, pivots, radii, longest)
                need = bound + SLACK * (1 + np.abs(bound)) >= floor[:, None]
                need &= (radii >= 0) & (batch.column("cell").to_numpy()[:, None] != np.arange(len(pivots)))
                row, cell = np.nonzero(need)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), batch.column("q").take(pa.array(row)), pa.array(cell.astype(np.int32))], names=["query_id", "q", "visit"])

    return run


def _sample(sound: DataFrame, rows: int, limit: int) -> list:
    """The ``limit`` vectors of least hash; a cut of the hash lets through about twice as many, so no partition sends many."""
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30))
    found = sound.where(place < int(min(1.0, 2 * limit / rows) * (1 << 30))).orderBy(place, "v").limit(limit).select("v").collect()
    return found if found else sound.limit(1).select("v").collect()


def top_k(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest integer inner products of each query row, its own id left out.

    ``queries`` tells which rows of ``vectors`` (vec_id, embedding) are queries. Components become floor(256 x). Vectors
    that are null or hold a null or non-finite component, and empty ones, take no part; a vector only meets those of its own
    length. Ties go to the smaller vec_id, a null vec_id is a candidate that comes last among ties; rows with the
    query's own vec_id are the query's own; of query rows that share an id the smallest vector asks; fewer than k
    candidates give fewer rows; an empty table gives none. Scores are exact below 2**53. Other columns are ignored.
    """
    spark = vectors.sparkSession
    sound = vectors.select("vec_id", quantised(F.col("embedding")).alias("v"), queries.alias("asks")).where("v is not null")
    lengths = sound.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # a row for each length
    found = [_search(sound.where(F.size("v") == d), d, n, k) for d, n in lengths if d]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found)


def _search(sound: DataFrame, dim: int, rows: int, k: int) -> DataFrame:
    """:func:`top_k` over sound vectors (vec_id, v, asks) of one length."""
    spark = sound.sparkSession
    count = min(PIVOTS, max(1, int(rows**0.5)))
    sample = _sample(sound, rows, min(SAMPLE, 16 * count))
    pivots = fit_pivots(np.array([x[0] for x in sample], float).reshape(len(sample), dim), count)
    placed = cut(sound.select("vec_id", "v").mapInArrow(_place(pivots), PLACED), "knn-placed")
    longest = F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")
    summary = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("radius").alias("radius"), longest, F.count("*").alias("n")).collect()}  # a row a pivot
    radii, norms = (np.array([summary[c][x] if c in summary else -1.0 for c in range(len(pivots))]) for x in ("radius", "longest"))
    asked = placed.join(sound.where("asks").groupBy("vec_id").agg(F.min("v").alias("q")), "vec_id").where("v = q")
    asked = cut(asked.select(F.col("vec_id").alias("query_id"), "q", "cell").dropDuplicates(["query_id"]), "knn-queries")

    def met(pairs: DataFrame) -> DataFrame:
        """The best k of each visited block, for rows (query_id, q, visit)."""
        pairs = cut(pairs, "knn-visits")
        visited = pairs.groupBy("visit").count().collect()  # a row a pivot
        deal = [(c, -(-summary[c]["n"] // BLOCK), -(-n // QUERY_BLOCK)) for c, n in visited]
        groups = F.broadcast(spark.createDataFrame(deal, "c int, blocks int, parts int"))  # a row a pivot
        data = placed.join(groups, placed["cell"] == groups["c"]).select(
            "vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        )
        dealt = pairs.join(groups, pairs["visit"] == groups["c"]).select(
            "query_id", "q", F.col("visit").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part")
        )
        keys = ["cell", "block", "part"]
        return data.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_solve(k), FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    own = cut(met(asked.select("query_id", "q", F.col("cell").alias("visit"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "knn-own")
    floors = own.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    far = asked.join(floors, "query_id", "left").select("query_id", "q", "cell", "floor").mapInArrow(_visits(pivots, radii, norms), "query_id long, q array<double>, visit int")
    found = own.select("query_id", "vec_id", "score").unionByName(met(far))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
