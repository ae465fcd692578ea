"""Readers of text formats, each a DataFrame; what can't be read is counted or kept aside, never fatal and never a zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; all columns are strings and a byte-order mark is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines (compressed ones too) with ``_corrupt`` for lines that aren't of the schema."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def replay(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, one row with ``bad_lines``) of JSON lines; a truncated tail is a bad line."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"), "value")
    sound = F.expr("try_parse_json(value) IS NOT NULL")
    return lines.where(sound).select("x.*"), lines.agg(F.count_if(~sound).alias("bad_lines"))


def read_json_records(spark: SparkSession, path: str, pointer: str | None = None) -> DataFrame:
    """The objects of a JSON document: of its own array, or of the array at a dotted pointer."""
    df = spark.read.json(path, multiLine=True)
    return df.select(F.explode(F.col(pointer)).alias("x")).select("x.*") if pointer else df


def read_feed(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Entries of RSS and Atom documents, one row each: title, link and date."""
    x = F.regexp_replace(F.regexp_replace(column, r"<\?xml[^>]*\?>", ""), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    names = lambda *paths: F.array_compact(F.flatten(F.array(*(F.xpath(x, F.lit(p)) for p in paths))))
    entries = F.arrays_zip(
        names("//item/title/text()", "//entry/title/text()").alias("title"), names("//item/link/text()", "//entry/link/@href").alias("link"),
        names("//item/pubDate/text()", "//entry/updated/text()").alias("date"),
    )
    return documents.select(F.explode(entries).alias("e")).select("e.*")


def read_sitemap(documents: DataFrame, column: str = "xml") -> DataFrame:
    """loc and lastmod of the entries of sitemaps and sitemap indexes."""
    x = F.regexp_replace(F.regexp_replace(column, r"<\?xml[^>]*\?>", ""), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    both = lambda leaf: F.concat(F.xpath(x, F.lit(f"//url/{leaf}/text()")), F.xpath(x, F.lit(f"//sitemap/{leaf}/text()")))
    return documents.select(F.explode(F.arrays_zip(both("loc").alias("loc"), both("lastmod").alias("lastmod"))).alias("e")).select("e.*")


def patch_lines(patches: DataFrame, column: str = "patch") -> DataFrame:
    """(path, line, text) of the lines that unified diffs add, numbered as in the new file."""
    files = patches.select(F.explode(F.filter(F.split(column, r"(?m)^(?=diff --git )"), lambda x: x != "")).alias("f"))
    path = F.regexp_extract("f", r"(?m)^\+\+\+ (?:b/)?(\S+)", 1)
    hunks = files.select(path.alias("path"), F.explode(F.regexp_extract_all("f", F.lit(r"(?ms)^@@ -\S+ \+\d+.*?(?=^@@ |\z)"), 0)).alias("h"))
    start = F.regexp_extract("h", r"^@@ -\S+ \+(\d+)", 1).cast("int")
    body = F.filter(F.slice(F.split("h", "\n"), 2, 1_000_000), lambda x: x.rlike("^[+ ]"))  # removed lines take no number
    numbered = hunks.select("path", start.alias("start"), F.posexplode(body).alias("k", "x"))
    return numbered.where("x LIKE '+%'").select("path", (F.col("start") + F.col("k")).alias("line"), F.substring("x", 2, 1_000_000).alias("text"))


#: What of a Cobertura report is read.
_COBERTURA = "`_lines-valid` LONG, `_lines-covered` LONG, packages STRUCT<package: ARRAY<STRUCT<classes: STRUCT<class: ARRAY<STRUCT<_filename: STRING, lines: STRUCT<line: ARRAY<STRUCT<_number: INT, _hits: LONG>>>>>>>>>"


def read_cobertura(reports: DataFrame, column: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(path, line, hits) with the hits of all classes of a file added up, and (valid, covered) as each report declares them."""
    x = reports.select(F.from_xml(column, _COBERTURA).alias("x"))
    classes = x.select(F.explode("x.packages.package").alias("p")).select(F.explode("p.classes.class").alias("c"))
    lines = classes.select(F.col("c._filename").alias("path"), F.explode("c.lines.line").alias("l")).where("path IS NOT NULL AND l._number IS NOT NULL")
    totals = x.select(F.col("x.`_lines-valid`").alias("valid"), F.col("x.`_lines-covered`").alias("covered"))
    return lines.groupBy("path", F.col("l._number").alias("line")).agg(F.sum("l._hits").alias("hits")), totals


def bitmap_lines(bitmaps: DataFrame, column: str = "bitmap") -> DataFrame:
    """The rows of ``bitmaps`` for each set bit, with its number as ``line``: bit k of byte b is line 8 b + k. Null and empty ones have none."""
    bytes_ = bitmaps.select("*", F.posexplode(F.regexp_extract_all(F.hex(column), F.lit(".."), 0)).alias("_at", "_byte")).drop(column)
    on = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.pmod(F.floor(F.conv("_byte", 16, 10).cast("int") / F.pow(F.lit(2), k)), F.lit(2)) == 1)
    return bytes_.withColumn("_bit", F.explode(on)).withColumn("line", F.col("_at") * 8 + F.col("_bit")).drop("_at", "_byte", "_bit")


def read_bookmarks(documents: DataFrame, column: str = "html") -> DataFrame:
    """(url, title, tags, added) of the links of an exported bookmark page; ``added`` is in seconds, null where it isn't a number."""
    links = documents.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?is)<a\s[^>]*>.*?</a>"), 0)).alias("a"))
    attribute = lambda name: F.regexp_extract("a", rf'(?i)^<a\s[^>]*?\b{name}="([^"]*)"', 1)
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    tags = F.filter(F.transform(F.split(plain(attribute("tags")), ","), lambda x: F.trim(x)), lambda x: x != "")
    title = plain(F.trim(F.regexp_replace(F.regexp_extract("a", r"(?is)^<a\s[^>]*>(.*)</a>$", 1), "<[^>]*>", "")))
    return links.select(plain(attribute("href")).alias("url"), title.alias("title"), tags.alias("tags"), attribute("add_date").try_cast("long").alias("added")).where("url <> ''")


def unpack_ids(packed: DataFrame, column: str = "bin") -> DataFrame:
    """``packed`` with ``ids``, the unsigned 16-bit little-endian numbers of its blob; a null blob has null."""
    words = F.regexp_extract_all(F.hex(column), F.lit(".{4}"), 0)  # one pass over the blob
    return packed.withColumn("ids", F.transform(words, lambda w: F.conv(F.concat(F.substring(w, 3, 2), F.substring(w, 1, 2)), 16, 10).cast("int")))
