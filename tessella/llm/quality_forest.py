"""Quality rules: an isolation forest over rule statistics.

Every text gives a few counts (the base statistics) and from them a point of shares. Trees of random cuts part the box of
all possible points; the path of a point ends early where few training points lie, so short paths mark anomalies. The trees
are grown on a bounded sample of rows labelled good (of all rows, where none is labelled), and the threshold on the score
is calibrated from all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .common import no_state, slices

_SPACES = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long, n_upper long, n_digits long, n_short long, n_once long"
BASE_COLUMNS = [x.split()[0] for x in BASE.split(", ")]
#: Rows that the forest is grown on, at most; rows are taken by the hash of their id.
SAMPLE = 8_192
TREES, TREE_ROWS, SEED = 128, 256, 7
#: The share of rows labelled good that the threshold may reject.
GOOD_LOSS = 0.002
#: Bins of the calibration histogram.
BINS = 4_096
_PAD = 4


def repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 6:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    # Windows of 2, 4 and 5 words get ranks, so that equality of ranks is equality of words.
    _, two = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)
    _, five, counts = np.unique(four[:-1] * len(seen) + ids[4:], return_inverse=True, return_counts=True)
    hit = counts[five] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(hit)] += hit
    edge[5 : 5 + len(hit)] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_statistics(text: str | None) -> tuple[int, ...]:
    """The statistics of one text in the order of ``BASE_COLUMNS`` after doc_id; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    solid = raw.translate(None, _SPACES)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if b"\n" in raw else []
    text = text or ""
    return (
        len(words),
        len(text) - (len(raw) - len(solid)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(solid) - len(solid.translate(None, b"!?.,;:\"'()[]{}-_/\\@~^=+`")),
        len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        len(solid) - len(solid.translate(None, b"0123456789")),
        sum(map((3).__gt__, map(len, words))),
        len(set(words)),
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    no_state()
    for batch in slices(batches):
        rows = [base_statistics(x) for x in batch.column("text").to_pylist()]
        columns = list(zip(*rows, strict=True)) or [()] * (len(BASE_COLUMNS) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in columns)], names=BASE_COLUMNS)


def features(base: np.ndarray) -> np.ndarray:
    """Points from base statistics (columns after doc_id): shares of words and characters, each cut to 0..1."""
    n_words, chars, symbols, dup_lines, repeat, marks, upper, digits, short, once = base.T.astype(np.float64)
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    shares = [symbols / w, repeat / w, dup_lines / w * 5, chars / w / 40, marks / w / 2, upper / c, digits / c, short / w, 1 - once / w]
    return np.clip(np.column_stack(shares), 0, 1)


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: the feature, cut and children of each node, and the path length at each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    length: np.ndarray
    depth: int
    norm: float

    def score(self, points: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1: two to the power of minus the mean path over its norm."""
        total = np.zeros(len(points))
        flat, width = points.ravel(), points.shape[1]
        rows = np.arange(len(points)) * width
        for feature, cut_, child, length in zip(self.feature, self.cut, self.child, self.length, strict=True):
            at = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                below = child[at]
                at = below + ((flat[rows + feature[at]] >= cut_[at]) & (below != at))
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _mean_path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(points: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """Isolation trees: each parts the unit box by random cuts, down to empty boxes or to the depth of its sample. Cuts are
    drawn over the node's box and not over the range of its points, so that a point outside all that was seen ends early."""
    rng = np.random.default_rng(seed)
    rows = max(1, min(rows, len(points)))
    depth = int(np.ceil(np.log2(max(rows, 2)))) + _PAD
    size = 9 if not len(points) else points.shape[1]
    grown = []
    for _ in range(trees):
        sample = points[rng.choice(len(points), rows, replace=False)] if len(points) else np.zeros((0, size))
        queue = [(sample, np.zeros(size), np.ones(size), 0)]
        feature, cuts, child, length = [], [], [], []
        for at, (mine, low, high, level) in enumerate(queue):  # grows while it runs
            if level >= depth or not len(mine):
                row = (0, 0.0, at, level + _mean_path(len(mine)))
            else:
                f = int(rng.integers(size))
                c = rng.uniform(low[f], high[f])
                left_high, right_low = high.copy(), low.copy()
                left_high[f] = right_low[f] = c
                goes = mine[:, f] >= c
                row = (f, c, len(queue), 0.0)
                queue += [(mine[~goes], low, left_high, level + 1), (mine[goes], right_low, high, level + 1)]
            for column, x in zip((feature, cuts, child, length), row, strict=True):
                column.append(x)
        grown.append((feature, cuts, child, length))
    width = max(len(x[0]) for x in grown)
    padded = [np.array([x[k] + [0] * (width - len(x[k])) for x in grown], kind) for k, kind in enumerate((np.int64, float, np.int64, float))]
    return Forest(*padded, depth, max(_mean_path(rows), 1.0))


def _scores(forest: Forest):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8_192):
            base = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in BASE_COLUMNS[1:]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(features(base)))], names=[*BASE_COLUMNS, "anomaly"])

    return score


def statistics(docs: DataFrame) -> DataFrame:
    """``BASE_COLUMNS`` of every row of ``docs``; a map over whole texts."""
    return docs.select("doc_id", "text").mapInArrow(_statistics, BASE)


def fit(base: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """The forest of at most ``sample`` rows labelled good, taken by the hash of their id."""
    good = labels.where("quality = 1").select("doc_id").distinct()
    rows = _by_hash(base.join(good, "doc_id", "left_semi"), sample, good.count()) or _by_hash(base, sample, base.count())
    return grow(features(np.array(rows, np.float64).reshape(-1, len(BASE_COLUMNS))[:, 1:]))


def _by_hash(base: DataFrame, limit: int, rows: int) -> list:
    """The ``limit`` rows of least hash. A cut of the hash lets through about twice as many of ``rows``, so no partition
    sends many; if it leaves under half of what it should, all rows are tried."""
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(3)), F.lit(1 << 30))
    ordered = lambda df: df.na.fill(-1, ["doc_id"]).orderBy(place, *BASE_COLUMNS).limit(limit).collect()
    found = ordered(base.where(place < int(min(1.0, 2 * limit / max(rows, 1)) * (1 << 30))))
    return found if rows <= 2 * limit or 2 * len(found) >= limit else ordered(base)


def base_failed() -> Column:
    """The plain rule: fewer than 10 words, or over a fifth of them in repeated 5-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """The score from which a row is rejected. Of rows that the base rule passes: of the thresholds that reject at most
    ``GOOD_LOSS`` of those labelled good, the lowest that no bad row profits from raising. Without bad rows nothing is rejected."""
    scored = scored.where(~base_failed())
    judged = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = (
        scored.join(judged, "doc_id").groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()
    )
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for row in counts:
        good[row["bin"]], bad[row["bin"]] = row["good"], row["bad"]
    above = lambda x: np.cumsum(x[::-1])[::-1]
    lost, caught = above(good), above(bad)
    allowed = lost <= GOOD_LOSS * good.sum()
    gain = np.where(allowed, caught / max(bad.sum(), 1) - lost / max(good.sum(), 1), -1)
    if not bad.sum() or gain.max() <= 0:
        return 1.0
    best = np.flatnonzero(gain == gain.max())
    return float(best[len(best) // 2] / BINS)


def _learn(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Forest, float]:
    base = cut(statistics(docs), "quality-base")
    forest = fit(base, labels)
    scored = cut(base.mapInArrow(_scores(forest), BASE + ", anomaly double"), "quality-scored")
    return scored, forest, calibrate(scored, labels)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, anomaly, base_failed and kept for every row of ``docs`` (doc_id, text).

    A null text has no words and fails the base rule; a null doc_id is scored but joins no label; rows that share a
    doc_id are judged each by its own text; an empty table gives no rows; without labels the forest is grown on all rows
    and only the base rule rejects. Other columns are ignored.
    """
    scored, _, limit = _learn(docs, labels)
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & (F.col("anomaly") < F.lit(limit)))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns that the op6 query returns."""
    return quality_verdicts(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def _filter(forest: Forest, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_state()
        for batch in slices(batches):
            base = np.array([base_statistics(x) for x in batch.column("text").to_pylist()], np.int64).reshape(-1, len(BASE_COLUMNS) - 1)
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            yield batch.filter(pa.array(~failed & (forest.score(features(base)) < limit)))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, each judged by its own text; columns and their order are kept.

    The model is learned in a first pass; the second is a map, so no text is shuffled and columns of any name pass. A null
    text goes, a null doc_id is judged like any other, equal rows stay or go together, an empty table stays empty.
    """
    _, forest, limit = _learn(docs, labels)
    return docs.mapInArrow(_filter(forest, limit), docs.schema)
