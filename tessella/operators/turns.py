"""Orders of sources and of rows: smooth weighted turns, a shuffle buffer."""

from __future__ import annotations

import random
from collections.abc import Iterator
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def smooth_turns(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    """(turn, source) of one period of smooth weighted turns over a registry of sources; it repeats after that.

    In each turn every source gains its weight, the one that holds most goes (ties to the first by name) and pays the sum of
    all weights. A source of weight w so goes w times a period, spread out. The registry is configuration, not data.
    """
    if not weights or min(weights.values()) <= 0:
        raise ValueError("each source needs a weight over 0")
    part = gcd(*weights.values())
    shares = {s: weights[s] // part for s in sorted(weights)}
    whole, held, turns = sum(shares.values()), dict.fromkeys(shares, 0), []
    for turn in range(whole):
        held = {s: x + shares[s] for s, x in held.items()}
        goes = max(held, key=held.__getitem__)
        held[goes] -= whole
        turns.append((turn, goes))
    return spark.createDataFrame(turns, "turn int, source string")


def shuffle_buffer(df: DataFrame, size: int, seed: int) -> DataFrame:
    """The rows of each partition in the order of a buffer of ``size`` rows: when it is full, a drawn row goes out and the next
    one takes its place. A row leaves at most ``size - 1`` places early; memory holds the buffer and one batch."""

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, held, schema = random.Random(seed), [], None
        for batch in batches:
            schema, out = batch.schema, []
            for row in batch.to_pylist():
                if len(held) < size:
                    held.append(row)
                    continue
                k = draw.randrange(size)
                out.append(held[k])
                held[k] = row
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            draw.shuffle(held)
            yield pa.RecordBatch.from_pylist(held, schema)

    return df.mapInArrow(shuffled, df.schema)
