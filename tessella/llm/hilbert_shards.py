"""Sharding along a Hilbert curve: several metadata dimensions are quantised, rows are sorted by curve index, runs are cut.

The dimensions of a document are its size, the script of its letters and the density of its words, taken from the text, so
equal texts share a cell and stand side by side (only the end of a run can part them). Runs are cut by the law ``rows``:
shard sizes differ by one row at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut, shuffle_width
from .common import prefix_sums

#: Bits of the curve for each dimension; the accuracy of the quantiles that part a dimension into cells.
BITS, ACCURACY = 5, 2_000
SHARDS = 24


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (one column a dimension, 0 to 2**bits - 1).

    The cells' coordinates are turned, from the highest bit down, into the frame of the sub-cube that the curve has reached
    (a swap or mirror of the lower bits), then read as a Gray code.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(n):
            up = (x[d] >> level) & 1 == 1
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            index = index << 1 | (x[d] >> level & 1)
    return index


def _curve(cuts: list[list[float]], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = [batch.column(f"dim{k}").to_numpy(zero_copy_only=False) for k in range(len(cuts))]
            cells = np.column_stack([np.searchsorted(c, d, "right") for c, d in zip(cuts, dims, strict=True)]) if dims else np.zeros((batch.num_rows, 0))
            names = [x for x in batch.schema.names if not x.startswith("dim")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(hilbert_index(cells, bits), pa.int64())], names=[*names, "curve"])

    return run


def curve_order(rows: DataFrame, dims: list[str], ties: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with ``curve`` (their place on the curve) and ``place`` (their rank from 0 in the order of curve and ties).

    Each dimension is cut into 2**bits cells at quantiles of all rows. The sort is by range, on all keys, so a crowded cell
    is split over tasks; places come from row counts of the written ranges, one number a range.
    """
    spark = rows.sparkSession
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = rows.select(*(F.percentile_approx(d, steps, ACCURACY).alias(d) for d in dims)).first()
    cuts = [sorted(set(found[d] or [])) for d in dims]
    keep = [c for c in rows.columns if c not in dims]
    wide = rows.select(*keep, *(F.col(d).cast("double").alias(f"dim{k}") for k, d in enumerate(dims)))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    curved = cut(wide.mapInArrow(_curve(cuts, bits), f"{kinds}, curve long"), "hilbert-curve")
    keys = ["curve", *ties]
    ranges = curved.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    numbered = cut(ranges.withColumn("row_id", F.monotonically_increasing_id()), "hilbert-sorted")
    split = numbered.withColumn("range", F.shiftright("row_id", 33)).withColumn("inner", F.col("row_id").bitwiseAND((1 << 33) - 1))
    counts = split.groupBy("range").count().orderBy("range").collect()  # one row a range of the sort
    starts = spark.createDataFrame(list(zip([r["range"] for r in counts], prefix_sums([r["count"] for r in counts]), strict=True)), "range long, start long")
    return split.join(F.broadcast(starts), "range").withColumn("place", F.col("start") + F.col("inner")).drop("range", "inner", "start", "row_id")


def cut_runs(placed: DataFrame, shards: int, rows: int) -> DataFrame:
    """``shard`` and ``slot`` by the law of rows: the first ``rows % shards`` runs hold one row more than the others."""
    small, more = divmod(rows, shards)
    edge = more * (small + 1)
    place = F.col("place")
    early = place < edge
    shard = F.when(early, F.floor(place / F.lit(small + 1))).otherwise(more + F.floor((place - edge) / F.lit(max(small, 1))))
    slot = F.when(early, place % F.lit(small + 1)).otherwise((place - edge) % F.lit(max(small, 1)))
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long"))


def _script(text: Column) -> Column:
    """Share of the text's bytes that lie outside ASCII."""
    return (F.octet_length(text) - F.char_length(text)) / F.greatest(F.octet_length(text), F.lit(1))


#: Name of the passing column of row numbers, which no table should have.
ROW = "__shard_row"


def shard_documents(docs: DataFrame, shards: int = SHARDS, row: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs`` (doc_id, text).

    ``size`` is the text's UTF-8 bytes plus 8. A null text has no bytes and the crc32 of none; a null doc_id is ordered
    first among equal texts; rows equal in text and doc_id follow each other in either order; with fewer rows than shards
    some shards are empty; an empty table gives no rows; other columns are ignored. ``row`` names a column that numbers the
    rows, which is kept and breaks the last ties.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = F.octet_length(text) - F.octet_length(F.translate(text, " \t\n", ""))
    facts = cut(
        docs.select(
            "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("d_size"), _script(text).alias("d_script"),
            (spaces / F.greatest(F.octet_length(text), F.lit(1))).alias("d_words"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        ),
        "hilbert-facts",
    )
    placed = curve_order(facts, ["d_size", "d_script", "d_words"], ["text_crc32", "text_hash", "doc_id", "row"])
    rows = facts.count()
    return cut_runs(placed, shards, rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *([F.col("row").alias(row)] if row else [])
    )


def write_shards(docs: DataFrame, out: str, shards: int = SHARDS) -> str:
    """Write whole ``docs`` to ``out``, one folder a shard, sorted by slot inside.

    Rows are numbered first and meet their shard by number, so equal rows have shards and slots of their own. Null texts
    and ids are rows like others; other columns, whatever their names, are kept.
    """
    numbered = cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "hilbert-numbered")
    found = shard_documents(numbered.select("doc_id", "text", ROW), shards, ROW).select(ROW, F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    met = numbered.join(found, ROW).drop(ROW)
    met.repartitionByRange(shuffle_width(docs.sparkSession), "__shard", "__slot").sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(out)
    return out
