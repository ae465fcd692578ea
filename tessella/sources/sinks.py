"""Sinks: partitioned tables with a manifest, exports, idempotent upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_release(df: DataFrame, out: str, split: str, key: str) -> DataFrame:
    """Write ``df`` by split and return the manifest: rows and a digest of the keys of each split, free of row order."""
    df.write.partitionBy(split).parquet(f"{out}/rows")
    digest = F.bit_xor(F.xxhash64(key))
    manifest = df.groupBy(split).agg(F.count("*").alias("rows"), F.hex(digest).alias("digest"))
    manifest.write.parquet(f"{out}/manifest")
    return df.sparkSession.read.parquet(f"{out}/manifest")


def export_csv(df: DataFrame, out: str) -> str:
    df.write.csv(out, header=True, escape='"')
    return out


def upsert(current: DataFrame, batch: DataFrame, key: list[str], version: str) -> DataFrame:
    """The newest row of each key of both; the same batch again changes nothing."""
    both = current.unionByName(batch)
    rest = [c for c in current.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(version, F.to_json(F.struct(*rest)))).alias("x")
    return both.groupBy(*key).agg(newest).select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))


def bitmaps_of(lines: DataFrame, key: str) -> DataFrame:
    """(key, bitmap) of the sets of lines (key, line), as :func:`~tessella.sources.readers.bitmap_lines` reads them."""
    bits = lines.select(key, "line").distinct().groupBy(key, F.floor(F.col("line") / 8).alias("at")).agg(F.sum(F.pow(F.lit(2), F.col("line") % 8)).cast("int").alias("byte"))
    held = bits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "byte"))).alias("m"), F.max("at").alias("last"))
    byte = lambda k: F.lpad(F.hex(F.coalesce(F.try_element_at("m", k), F.lit(0))), 2, "0")
    return held.select(key, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), "last"), byte), "")).alias("bitmap"))


def pack_ids(df: DataFrame, ids: str = "ids") -> DataFrame:
    """``df`` with ``bin`` in place of ``ids``: two little-endian bytes an id. An id outside 0 to 65535 is an error."""
    wide = F.exists(ids, lambda x: (x < 0) | (x > 65_535) | x.isNull())
    hexed = F.transform(ids, lambda x: F.lpad(F.hex(x), 4, "0"))
    blob = F.unhex(F.array_join(F.transform(hexed, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), ""))
    return df.withColumn("bin", F.when(wide, F.raise_error(F.lit("an id doesn't fit 16 bits"))).otherwise(blob)).drop(ids)


def write_token_shards(df: DataFrame, out: str, part: str, ids: str = "ids") -> str:
    """Write packed ids by ``part``; a row keeps its own index columns beside its blob."""
    pack_ids(df, ids).write.partitionBy(part).parquet(out)
    return out
