"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in SQL expressions only.

Every source has a target of words. Whole epochs of a source come first; the rest of its target is a weighted sample without
replacement: each document draws the exponential key -ln(u)/w from a hash of its id and its quality weight w, documents are
taken in rising order of the key, and a prefix sum of sizes cuts them off at the target. The prefix sum has two levels: rows
are sorted by range on source, key and all that tells rows apart, down to their own numbers, so no source and no group of
equal rows is held by one task; the ranges' sums come first, then the rows inside a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, shuffle_width

#: Weights by rank of the source, repeating; the mix's size against all words; copies that a source may give at most.
WEIGHTS, TOTAL, EPOCHS = (3, 1, 2), 1.5, 2
#: Marks that lower a document's quality weight.
_MARKS = r"[#*$%&|<>{}\[\]_=~^@/\\0-9]+"


def size_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """Weight between 0.1 and 1: the share of characters that aren't digits or marks."""
    chars = F.greatest(F.char_length(text), F.lit(1))
    return F.coalesce(0.1 + 0.9 * F.char_length(F.regexp_replace(text, _MARKS, "")) / chars, F.lit(1.0))


def uniform_of(key: Column, text: Column) -> Column:
    """A number inside (0, 1) from 52 bits of the md5 of the id and the text's md5, the same at every run."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    head = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), content).cast("binary")), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size and target for each source of ``sizes`` (source, source_size).

    Sources are ranked by code point, null last. Their weights share ``total`` times all words; a target stops at
    ``epochs`` times the source's size and the excess is shared again by weight until none is above. In the order of cap
    to weight the capped sources are a prefix, so one pass of running sums finds them. One row a source: a table of this
    many rows is sorted in one task.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        (F.sum("source_size").over(whole) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    leveled = capped.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    # The level that the first free source sees holds for all after it.
    held = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(whole)
    chosen = leveled.withColumn("held", held)
    target = F.when(F.col("free") | (F.col("cap") > F.coalesce(F.col("held.level") * F.col("weight"), F.lit(float("inf")))), F.col("held.level") * F.col("weight")).otherwise(F.col("cap"))
    return chosen.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS, whole: bool = False, row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and source for every row of ``docs`` (doc_id, source, text).

    ``taken`` counts words, repeats included: the whole epochs of the source, then the document's share of the rest. The
    document that straddles the end of the target is taken up to it, or with ``whole`` wholly if that comes nearer.
    A null text has size 0 and takes 0; a null source is a source of its own, last in order; a null doc_id draws by its text
    alone; rows of equal key are ordered by id, size and the hash of their text, and of fully equal rows, which nothing
    tells apart, either may come first; an empty table gives no rows; other columns are ignored. ``row`` names a column that
    numbers the rows, which is kept.
    """
    spark = docs.sparkSession
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = cut(
        docs.select(
            "doc_id", "source", size_of(F.col("text")).alias("size"), (-F.log(uniform_of(F.col("doc_id"), F.col("text"))) / quality_of(F.col("text"))).alias("key"),
            F.xxhash64("text").alias("text_hash"), number.alias("row"),
        ),
        "mix-sizes",
    )
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, total, epochs).withColumn("rest", F.col("target") - F.col("source_size") * F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    keys = ["key", "doc_id", "size", "text_hash", "row"]
    ranged = cut(rows.repartitionByRange(shuffle_width(spark), "source", *keys).withColumn("range", F.spark_partition_id()), "mix-ranges")
    ranges = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))  # a row for each range and source in it
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    cuts = cut(ranges.join(targets, ranges["source"].eqNullSafe(targets["source"])).select(ranges["source"].alias("s"), F.col("range").alias("b"), "range_start", "source_size", "target", "rest"), "mix-cuts")
    inside = Window.partitionBy("source", "range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(cuts, placed["source"].eqNullSafe(cuts["s"]) & (placed["range"] == cuts["b"]))
    left = F.col("rest") - F.col("range_start") - F.col("inner")
    part = F.when(left >= F.col("size"), F.col("size")).when(left <= 0, 0)
    part = part.when(left * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole else part.otherwise(F.floor(left))
    copies = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    taken = (copies * F.col("size") + part).cast("long").alias("taken")
    return joined.select("doc_id", "size", "source_size", "target", taken, "source", *([F.col("row").alias(row)] if row else []))


#: Name of the passing column of row numbers, which no table should have.
ROW = "__mix_row"


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it whole; rows that it doesn't take, and those without a word, go.

    Rows are numbered first, so each of some equal rows has its own count, and copies meet rows by number: no key is hot,
    nulls and repeats are rows like others, and other columns, whatever their names, are kept in order.
    """
    numbered = cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "mix-numbered")
    taken = mix(numbered.select("doc_id", "source", "text", ROW), whole=True, row=ROW).where("taken > 0")
    copies = taken.select(ROW, F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")).alias("__mix_copies"))
    met = numbered.join(copies, ROW)
    return met.withColumn("__mix_copy", F.explode("__mix_copies")).select(*(F.col(f"`{c}`") for c in docs.columns))


#: The same rows in DuckDB's SQL: the digest of the op10 query, whose water level is found by comparing every candidate.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(0.1 + 0.9 * length(regexp_replace(text, '[#*$%&|<>{}\[\]_=~^@/\\0-9]+', '', 'g')) / greatest(length(text), 1), 1.0) AS quality,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
    [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
level AS (
  SELECT max((1.5::DOUBLE * t.total - coalesce(t.capped, 0)) / t.weight) AS v FROM (
    SELECT c.source, (SELECT sum(source_size) FROM s) AS total,
      sum(2::DOUBLE * o.source_size) FILTER (2 * o.source_size / o.w < 2 * c.source_size / c.w) AS capped,
      sum(o.w) FILTER (NOT 2 * o.source_size / o.w < 2 * c.source_size / c.w) AS weight
    FROM s c, s o GROUP BY c.source, c.source_size, c.w) t),
t AS (SELECT source, source_size, least(2 * source_size, (SELECT v FROM level) * w) AS target FROM s),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target / greatest(t.source_size, 1)) AS copies,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.quality, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (copies * size + greatest(0, least(size, floor(target - copies * source_size - ahead))))::BIGINT AS taken
FROM p
"""
