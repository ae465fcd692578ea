"""Scores of predictions: ROC area, bootstrap intervals, ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ranking import global_rank


def roc_auc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve of ``df`` (score, y) with mid-ranks for ties; null if a class is empty.

    Scores are combined first; the ranks of the distinct scores are prefix sums of their counts, by ranges.
    """
    v = df.groupBy("score").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    placed = global_rank(v, ["score"])
    # A block of ranks at a time: sums of blocks first, then inside each block.
    block = F.floor(F.col("place") / 10_000).alias("block")
    blocked = placed.withColumn("block", block)
    sums = blocked.groupBy("block").agg(F.sum("n").alias("m"))
    before = sums.withColumn("start", F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.sum("n").over(Window.partitionBy("block").orderBy("place"))
    r = blocked.withColumn("inner", inner).join(before, "block").withColumn("mid", F.col("start") + F.col("inner") - F.col("n") + (F.col("n") + 1) / 2)
    pos, n = F.sum("pos"), F.sum("n")
    return r.agg(F.round(F.try_divide(F.sum(F.col("mid") * F.col("pos")) - pos * (pos + 1) / 2, pos * (n - pos)), 6).alias("auc"))


def bootstrap_mean(df: DataFrame, draws: int, seed: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Interval of the mean of ``df`` (id, x) by Poisson bootstrap: each row has its own count in each draw, from a hash
    of its id, so a draw is one weighted sum and no row is moved."""
    u = F.pmod(F.xxhash64("id", "draw", F.lit(seed)), F.lit(1 << 40)) / (1 << 40)
    # Counts of a Poisson variable of mean one, cut at six.
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    count = sum((F.when(u >= s, 1).otherwise(0) for s in steps[1:]), F.when(u >= steps[0], 1).otherwise(0))
    drawn = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("k", count)
    means = drawn.groupBy("draw").agg((F.sum(F.col("x") * F.col("k")) / F.sum("k")).alias("m"))
    return means.agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"), F.count("*").alias("draws"))


def fit_logistic(df: DataFrame, features: list[str], label: str, rounds: int, ridge: float = 1e-3) -> list[float]:
    """Bias and weights of a logistic model by Newton's method. Each round is one aggregate over all rows: the gradient and
    the curvature, whose size goes with the number of features and not of rows."""
    import numpy as np

    names = [F.lit(1.0), *map(F.col, features)]
    w = np.zeros(len(names))
    for _ in range(rounds):
        z = sum((n * float(a) for n, a in zip(names[1:], w[1:], strict=True)), F.lit(float(w[0])))
        p = 1 / (1 + F.exp(-z))
        slope = [F.sum(n * (F.col(label) - p)) for n in names]
        bend = [F.sum(a * b * p * (1 - p)) for i, a in enumerate(names) for b in names[: i + 1]]
        row = list(df.agg(*slope, *bend, F.count("*")).first())
        k, n = len(names), max(row[-1], 1)
        g, h = np.array([x or 0.0 for x in row[:k]]) / n - ridge * w, np.zeros((k, k))
        h[np.tril_indices(k)] = [x or 0.0 for x in row[k:-1]]
        h = (h + np.tril(h, -1).T) / n + ridge * np.eye(k)
        w = w + np.linalg.solve(h, g)
    return w.tolist()
