"""Reports, bitmaps, bookmarks and shards read back; names checked against a schema; nodes merged; links of pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.graphs import walk
from ..operators.ranking import running_sum
from ..operators.turns import shuffle_buffer, smooth_turns
from ..session import shared_dir
from ..sources import readers, sinks
from .base import Tables, plan


def _place(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/tessella/{name}-{uuid.uuid4().hex}"


@plan("src13_cobertura", "SELECT 'src/' || p_brand || '.py' AS path, p_size AS line, sum(p_partkey % 3)::BIGINT AS hits FROM part GROUP BY ALL")
def cobertura(t: Tables):
    """Reports of one class a part, whose files are its brand."""
    n = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit('<class name="c" filename="src/'), "p_brand", F.lit('.py"><lines><line number="'), n("p_size"), F.lit('" hits="'), (F.col("p_partkey") % 3).cast("string"), F.lit('"/></lines></class>'))
    xml = F.concat(F.lit('<coverage lines-valid="50" lines-covered="40"><packages><package name="p"><classes>'), F.array_join(F.collect_list(line), ""), F.lit("</classes></package></packages></coverage>"))
    return readers.read_cobertura(t.part.groupBy(F.floor(F.col("p_partkey") / 50)).agg(xml.alias("xml")).select("xml"))[0]


@plan("src14_bitmap_lines", "SELECT DISTINCT user_id, (event_id * 7 % 300)::INT AS line FROM events")
def bitmap_round_trip(t: Tables):
    lines = t.events.select("user_id", (F.col("event_id") * 7 % 300).cast("int").alias("line"))
    return readers.bitmap_lines(sinks.bitmaps_of(lines, "user_id"))


@plan("src16_bookmarks", "SELECT 'http://x/?a=1&b=' || p_partkey AS url, p_name AS title, p_brand || '|' || p_size AS tags, 1700000000 + p_partkey AS added FROM part")
def bookmarks(t: Tables):
    n = lambda c: F.col(c).cast("string")
    link = F.concat(F.lit('<DT><A HREF="http://x/?a=1&amp;b='), n("p_partkey"), F.lit('" ADD_DATE="'), (F.col("p_partkey") + 1_700_000_000).cast("string"), F.lit('" TAGS="'), "p_brand", F.lit(", "), n("p_size"), F.lit('">'), "p_name", F.lit("</A>\n"))
    pages = t.part.groupBy(F.floor(F.col("p_partkey") / 50)).agg(F.concat(F.lit("<!DOCTYPE NETSCAPE-Bookmark-file-1><DL><p>"), F.array_join(F.collect_list(link), ""), F.lit("</DL>")).alias("html"))
    return readers.read_bookmarks(pages.select("html")).withColumn("tags", F.array_join("tags", "|"))


_TOKENS = r"w AS (SELECT doc_id, source, [len(x) % 65536 for x in regexp_split_to_array(text, '[ \t\n\r\f\x0B]+') if x <> ''] AS ids FROM documents)"


@plan("snk02_token_shards", f"WITH {_TOKENS} SELECT source, doc_id, (sum(len(ids)) OVER (ORDER BY doc_id) - len(ids))::BIGINT AS begins, len(ids) AS n, coalesce(list_sum([ids[i] * i for i in range(1, len(ids) + 1)]), 0)::BIGINT AS mark FROM w")
def token_shards(t: Tables):
    """Lengths of words stand for ids: written as 16-bit blobs by source with their offsets, then read back."""
    ids = F.transform(tokens(F.col("text")), lambda x: F.length(x) % 65_536)
    d = running_sum(t.documents.select("doc_id", "source", ids.alias("ids")).withColumn("n", F.size("ids").cast("long")), ["doc_id"], "n")
    out = sinks.write_token_shards(d.withColumnRenamed("before", "begins"), _place(t, "shards"), "source")
    back = readers.unpack_ids(t.spark.read.parquet(out))
    mark = F.aggregate(F.transform("ids", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select("source", "doc_id", F.col("begins").cast("long").alias("begins"), F.size("ids").cast("long").alias("n"), mark.alias("mark"))


@plan("snk05_csv_export", "SELECT url, length(html)::VARCHAR AS chars, 'say \"hi\", ' || page_id AS note FROM pages")
def csv_export(t: Tables):
    """A row for each address, with quotes and commas in a field."""
    rows = t.pages.select("url", F.length("html").alias("chars"), F.concat(F.lit('say "hi", '), F.col("page_id").cast("string")).alias("note"))
    return readers.read_csv(t.spark, sinks.export_csv(rows, _place(t, "csv")))


@plan("prj07_checked_names", "SELECT * FROM (VALUES ('ts', NULL), ('value', NULL), ('colour', 'not in the table'), ('user id', 'not a name'), ('1st', 'not a name')) x(name, problem)")
def checked_names(t: Tables):
    """Names of columns that a section asks for: a reason for each one that is no identifier or not in the live schema."""
    asked = t.spark.createDataFrame([("ts",), ("value",), ("colour",), ("user id",), ("1st",)], "name string")
    reason = F.when(~F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "not a name").when(~F.col("name").isin(t.events.columns), "not in the table")
    return asked.select("name", reason.alias("problem"))


@plan("gr01_node_merge", "SELECT user_id, event_type AS key, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def node_merge(t: Tables):
    """Nodes upserted event by event: a later property takes the place of an earlier one, the others stay."""
    merged = t.events.groupBy("user_id", F.col("event_type").alias("key")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    nodes = merged.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("props"))
    return nodes.select("user_id", F.explode("props"))


@plan("gr11_link_graph", """WITH l AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages), o AS (SELECT url AS node, count(*) AS links FROM l GROUP BY url), i AS (SELECT target AS node, count(*) AS linked FROM l GROUP BY target)
  SELECT node, coalesce(links, 0) AS links, coalesce(linked, 0) AS linked FROM o FULL JOIN i USING (node)""")
def link_graph(t: Tables):
    """Out and in degree of every page and target; a link that a page repeats counts once."""
    links = t.pages.select("url", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("target")).distinct()
    out, into = links.groupBy(F.col("url").alias("node")).agg(F.count("*").alias("links")), links.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("linked"))
    return out.join(into, "node", "full").select("node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked", F.lit(0)).alias("linked"))


@plan("db07_breadth_first", "WITH RECURSIVE r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 3 = node AND p_partkey > 1 WHERE depth < 8) SELECT node, min(depth) AS depth, (row_number() OVER (ORDER BY min(depth), node) - 1)::BIGINT AS place FROM r GROUP BY node")
def breadth_first(t: Tables):
    """Nodes of the tree of parts in the order in which a breadth-first walk from part 1 meets them."""
    from ..operators.ranking import global_rank

    e = t.part.where("p_partkey > 1").select(F.floor(F.col("p_partkey") / 3).alias("src"), F.col("p_partkey").alias("dst"))
    return global_rank(walk(e, t.spark.sql("SELECT 1L AS node"), 8), ["depth", "node"])


@plan("sr06_smooth_turns", "SELECT * FROM (VALUES (0, 'a'), (1, 'a'), (2, 'b'), (3, 'a'), (4, 'c'), (5, 'a'), (6, 'a')) x(turn, source)")
def turns(t: Tables):
    return smooth_turns(t.spark, {"a": 10, "b": 2, "c": 2})


@plan("sr07_shuffle_buffer", "SELECT event_id, user_id FROM events")
def buffered(t: Tables):
    """All events, each partition by way of a buffer of 64 rows."""
    return shuffle_buffer(t.events.select("event_id", "user_id"), 64, 7)
