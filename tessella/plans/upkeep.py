"""Queues, leases, cursors, incremental runs, signatures, versions, geometry and small models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, Window

from ..functions.text import shingles
from ..session import shared_dir
from .base import Tables, plan

_TASKS = "SELECT o_orderkey, o_orderpriority AS phase, o_orderdate AS created, o_orderkey % 4 AS attempts FROM orders WHERE o_orderstatus = 'P'"


@plan("sm01_claim", f"SELECT o_orderkey, attempts + 1 AS attempts FROM ({_TASKS}) WHERE attempts < 3 ORDER BY phase, created, o_orderkey LIMIT 50")
def claim(t: Tables):
    """The oldest open tasks by phase whose attempts aren't used up, as one batch claims them."""
    tasks = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderpriority").alias("phase"), F.col("o_orderdate").alias("created"), (F.col("o_orderkey") % 4).alias("attempts"))
    return tasks.where("attempts < 3").orderBy("phase", "created", "o_orderkey").limit(50).select("o_orderkey", (F.col("attempts") + 1).alias("attempts"))


@plan("sm02_requeue", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1998-01-01' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'RAW' ELSE 'CLEAN' END WHEN o_orderstatus = 'P' THEN 'CLAIMED' ELSE 'DONE' END AS state FROM orders")
def requeue(t: Tables):
    """A claim whose lease has ended goes back to the state that it was claimed from."""
    claimed, over = F.col("o_orderstatus") == "P", F.expr("o_orderdate + INTERVAL 30 DAY < TIMESTAMP_NTZ '1998-01-01'")
    origin = F.when(F.col("o_orderkey") % 2 == 0, "RAW").otherwise("CLEAN")
    return t.orders.select("o_orderkey", F.when(claimed & over, origin).when(claimed, "CLAIMED").otherwise("DONE").alias("state"))


@plan("sm03_cursor", "SELECT source, lang, max(doc_id) AS position, count(*) AS seen FROM documents GROUP BY ALL")
def cursor(t: Tables):
    """Where each source and phase goes on."""
    return t.documents.groupBy("source", "lang").agg(F.max("doc_id").alias("position"), F.count("*").alias("seen"))


@plan("sm04_backpressure", "SELECT o_orderpriority AS phase, count(*) FILTER (o_orderstatus = 'O') AS backlog, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'run' WHEN count(*) FILTER (o_orderstatus = 'O') > 2 * count(*) FILTER (o_orderstatus = 'F') THEN 'pause' ELSE 'run' END AS verdict FROM orders GROUP BY ALL")
def backpressure(t: Tables):
    """A phase pauses when its backlog outgrows what is done, unless it starves."""
    backlog, ready = F.count_if(F.col("o_orderstatus") == "O"), F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy(F.col("o_orderpriority").alias("phase")).agg(backlog.alias("backlog"), F.when(ready == 0, "run").when(backlog > 2 * ready, "pause").otherwise("run").alias("verdict"))


@plan("sm05_reindex", """WITH old AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 3), new AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 4)
  SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'pruned' WHEN o.h <> n.h THEN 'changed' ELSE 'same' END AS action FROM old o FULL JOIN new n ON o.doc_id = n.doc_id""")
def reindex(t: Tables):
    """What an index has to do to follow a folder: by hash, so an untouched text costs nothing."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    old = t.documents.where("doc_id % 10 <> 3").select("doc_id", F.md5(text.cast("binary")).alias("was"))
    new = t.documents.where("doc_id % 10 <> 4").select("doc_id", F.md5(F.col("text").cast("binary")).alias("now"))
    action = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "pruned").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return old.join(new, "doc_id", "full_outer").select("doc_id", action.alias("action"))


@plan("sm06_folded_stats", "SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY ALL")
def folded_stats(t: Tables):
    """Aggregates of parts, kept by part, folded into those of the whole."""
    parts = t.events.groupBy("event_type", (F.col("event_id") % 16).alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@plan("sm11_backwards_clock", "SELECT event_id, ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS backwards FROM events")
def backwards_clock(t: Tables):
    """Events whose time is before one that arrived earlier are marked and kept."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", (F.col("ts") < F.max("ts").over(w)).alias("backwards"))


@plan("sm13_sweep", "SELECT user_id, CASE WHEN max(ts) FILTER (event_type = 'view') IS NULL THEN 'never' WHEN max(ts) FILTER (event_type = 'view') < TIMESTAMP '2024-01-30' THEN 'dead' ELSE 'alive' END AS verdict, count(*) FILTER (event_type = 'view') AS beats FROM events GROUP BY ALL")
def sweep(t: Tables):
    """A dead-man sweep: who hasn't been heard from by a set time."""
    last = F.max(F.when(F.col("event_type") == "view", F.col("ts")))
    verdict = F.when(last.isNull(), "never").when(last < F.lit("2024-01-30").cast("timestamp_ntz"), "dead").otherwise("alive")
    return t.events.groupBy("user_id").agg(verdict.alias("verdict"), F.count_if(F.col("event_type") == "view").alias("beats"))


@plan("sm15_incremental_export", "SELECT event_id, value FROM events")
def incremental_export(t: Tables):
    """Two runs that each export what is newer than the mark that the run before left; together they hold every row once."""
    out = f"{shared_dir(t.spark)}/tessella/export-{uuid.uuid4().hex}"
    mark = -1
    for end in (t.events.agg(F.floor(F.avg("event_id"))).first()[0], None):
        fresh = t.events.where(F.col("event_id") > mark).where(F.lit(True) if end is None else F.col("event_id") <= end)
        fresh.select("event_id", "value").write.mode("append").parquet(out)
        mark = end if end is not None else mark
    return t.spark.read.parquet(out)


@plan("sr05_split_by_goal", "WITH g AS (SELECT l_partkey AS goal, count(*) AS n, md5('7' || l_partkey) AS h FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY h) - n AS before, sum(n) OVER () AS total FROM g) SELECT goal, before < 0.1 * total AS held_out FROM r")
def split_by_goal(t: Tables):
    """Goals in the order of a seeded hash are held out whole until they hold a tenth of the rows."""
    from ..operators.ranking import running_sum

    g = t.lineitem.groupBy(F.col("l_partkey").alias("goal")).agg(F.count("*").alias("n")).withColumn("h", F.md5(F.concat(F.lit("7"), F.col("goal").cast("string")).cast("binary")))
    return running_sum(g, ["h"], "n").select("goal", (F.col("before") < 0.1 * t.lineitem.count()).alias("held_out"))


@plan("sp04_paper_holdout", "WITH g AS (SELECT conv_id, count(*) AS n, md5(conv_id::VARCHAR) AS h FROM conversations GROUP BY ALL), r AS (SELECT *, sum(n) OVER (ORDER BY h) - n AS before, sum(n) OVER () AS total FROM g) SELECT conv_id, turn, before < 0.15 * total AS held_out FROM r JOIN conversations USING (conv_id)")
def paper_holdout(t: Tables):
    """All rows of a paper share a side."""
    from ..operators.ranking import running_sum

    g = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", F.md5(F.col("conv_id").cast("string").cast("binary")))
    side = running_sum(g, ["h"], "n").select("conv_id", (F.col("before") < 0.15 * t.conversations.count()).alias("held_out"))
    return t.conversations.select("conv_id", "turn").join(side, "conv_id")


#: Draws (a, b) of the hash family (a x + b) mod (2^31 - 1) of the signatures.
_PRIME = (1 << 31) - 1
_DRAWS = [(pow(48_271, k + 1, _PRIME), pow(69_621, k + 2, _PRIME)) for k in range(16)]
_SIG = r"""WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT DISTINCT id, ('0x' || substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 7))::BIGINT AS h FROM w, range(1, greatest(len(w) - 4, 1) + 1) r(i)),
  m AS (SELECT id, [""" + ", ".join(f"min((h * {a} + {b}) % {_PRIME})" for a, b in _DRAWS) + "] AS sig FROM s GROUP BY id)"


def _signatures(t: Tables):
    """(id, sig): for each draw the least value over the hashes of a text's shingles of five words."""
    h = F.transform(shingles(F.col("text"), 5), lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long"))
    rows = t.documents.select(F.col("doc_id").alias("id"), F.explode(h).alias("h"))
    return rows.groupBy("id").agg(F.array(*(F.min((F.col("h") * a + b) % _PRIME) for a, b in _DRAWS)).alias("sig"))


@plan("dd04_minhash", _SIG + " SELECT id AS doc_id, array_to_string(sig, ',') AS signature FROM m")
def minhash_signatures(t: Tables):
    return _signatures(t).select(F.col("id").alias("doc_id"), F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("signature"))


@plan("dd05_jaccard_estimate", _SIG + " SELECT a.id AS lo, b.id AS hi, len(list_filter(range(1, 17), lambda i: a.sig[i] = b.sig[i])) / 16 AS estimate FROM m a JOIN m b ON b.id = a.id + 1")
def jaccard_estimates(t: Tables):
    """The share of equal places of the signatures of documents that follow each other."""
    m = _signatures(t)
    pairs = m.select(F.col("id").alias("lo"), F.col("sig").alias("a")).join(m.select((F.col("id") - 1).alias("lo"), F.col("id").alias("hi"), F.col("sig").alias("b")), "lo")
    return pairs.select("lo", "hi", (F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x)) / 16).alias("estimate"))


@plan("dd07_lsh_buckets", _SIG + ", b AS (SELECT k, md5(k || ':' || array_to_string(sig[k * 4 + 1:k * 4 + 4], ',')) AS bucket FROM m, range(0, 4) r(k)) SELECT k AS band, bucket, count(*) AS n FROM b GROUP BY ALL HAVING count(*) > 1")
def lsh_buckets(t: Tables):
    """Buckets of more than one document: four bands of four, the band's number in the key."""
    band = lambda k: F.struct(F.lit(k).cast("long").alias("band"), F.md5(F.concat(F.lit(f"{k}:"), F.array_join(F.transform(F.slice("sig", k * 4 + 1, 4), lambda x: x.cast("string")), ",")).cast("binary")).alias("bucket"))
    return _signatures(t).select(F.explode(F.array(*map(band, range(4)))).alias("x")).groupBy("x.band", "x.bucket").agg(F.count("*").alias("n")).where("n > 1")


@plan("dd26_memory_recall", "SELECT p_partkey, 2 * len(list_intersect(string_split(lower(p_name), ' '), ['green', 'steel', 'small'])) + p_size / 50 - (CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 40")
def memory_recall(t: Tables):
    """Twice the shared words, plus authority, less one for a contradiction."""
    shared = F.size(F.array_intersect(F.split(F.lower("p_name"), " "), F.array(*map(F.lit, ("green", "steel", "small")))))
    return t.part.select("p_partkey", (2 * shared + F.col("p_size") / 50 - F.when(F.col("p_type") == "PROMO", 1).otherwise(0)).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(40)


@plan("dd29_leak_free", "SELECT item_id, NOT list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), (SELECT list(DISTINCT lower(source)) FROM documents)) AS leak_free FROM benchmark")
def leak_free(t: Tables):
    """Queries that don't name a target."""
    names = t.documents.agg(F.array_compact(F.collect_set(F.lower("source"))).alias("names"))  # a name for each source
    return t.benchmark.join(F.broadcast(names)).select("item_id", (~F.arrays_overlap(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), F.col("names"))).alias("leak_free"))


@plan("tx30_masked_keys", r"""SELECT event_id, regexp_replace('{"user": ' || user_id || ', "api_token": "x' || event_id || '", "inner": {"Password": "p", "k": 1}}', '(?i)("[^"]*(token|password|secret|api_key)[^"]*"\s*:\s*)"[^"]*"', '\1"***"', 'g') AS masked FROM events""")
def masked_keys(t: Tables):
    """Values of keys that name a secret are masked at any depth."""
    raw = F.concat(F.lit('{"user": '), F.col("user_id").cast("string"), F.lit(', "api_token": "x'), F.col("event_id").cast("string"), F.lit('", "inner": {"Password": "p", "k": 1}}'))
    return t.events.select("event_id", F.regexp_replace(raw, r'(?i)("[^"]*(token|password|secret|api_key)[^"]*"\s*:\s*)"[^"]*"', '$1"***"').alias("masked"))


@plan("tx35_version_order", """WITH v AS (SELECT p_partkey, p_size % 3 AS a, p_partkey % 4 AS b, p_partkey % 2 AS c, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 5 END AS rc FROM part)
  SELECT x.p_partkey, CASE WHEN k1 < k2 THEN -1 WHEN k1 > k2 THEN 1 ELSE 0 END AS verdict FROM (SELECT p_partkey, (a, b, c, coalesce(rc, 1000)) AS k1 FROM v) x JOIN (SELECT p_partkey - 1 AS p_partkey, (a, b, c, coalesce(rc, 1000)) AS k2 FROM v) y USING (p_partkey)""")
def version_order(t: Tables):
    """Each version against the next one's, by semantic versioning: a pre-release comes before its release, a build mark doesn't count."""
    from ..functions.columns import semver_key

    dotted = F.concat_ws(".", (F.col("p_size") % 3).cast("string"), (F.col("p_partkey") % 4).cast("string"), (F.col("p_partkey") % 2).cast("string"))
    text = F.concat(dotted, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-rc."), (F.col("p_partkey") % 5).cast("string"))).otherwise(""), F.lit("+b"), F.col("p_partkey").cast("string"))
    v = t.part.select("p_partkey", semver_key(text).alias("k"))
    pairs = v.join(v.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("k").alias("k2")), "p_partkey")
    return pairs.select("p_partkey", F.when(F.col("k") < F.col("k2"), -1).when(F.col("k") > F.col("k2"), 1).otherwise(0).alias("verdict"))


_RING = [(10.0, 10.0), (90.0, 20.0), (70.0, 80.0), (40.0, 50.0), (15.0, 85.0)]
_CROSS = " + ".join(f"(({y1} > y) <> ({y2} > y) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1})::INT" for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1], strict=True))


@plan("jn18_point_in_polygon", f"SELECT c_custkey FROM (SELECT c_custkey, (c_custkey * 37 % 101)::DOUBLE AS x, (c_custkey * 53 % 103)::DOUBLE AS y FROM customer) WHERE ({_CROSS}) % 2 = 1")
def point_in_polygon(t: Tables):
    """Points inside a ring: a box first, then whether a ray crosses an odd number of sides."""
    from ..functions.columns import inside_ring

    p = t.customer.select("c_custkey", (F.col("c_custkey") * 37 % 101).cast("double").alias("x"), (F.col("c_custkey") * 53 % 103).cast("double").alias("y"))
    return p.where(F.col("x").between(10, 90) & F.col("y").between(10, 85)).where(inside_ring(F.col("x"), F.col("y"), _RING)).select("c_custkey")


@plan("ag40_logistic_fit")
def logistic_fit(t: Tables):
    """Weights of a logistic model of purchases by value and hour; tested against the same descent in numpy."""
    from ..operators.scores import fit_logistic

    e = t.events.select((F.col("value") / 500).alias("x1"), (F.hour("ts") / 24).alias("x2"), (F.col("event_type") == "purchase").cast("double").alias("y"))
    weights = fit_logistic(e, ["x1", "x2"], "y", rounds=8)
    return t.spark.createDataFrame([tuple(map(float, weights))], "bias double, value double, hour double")


@plan("ag21_duplicate_groups", r"""WITH g AS (SELECT md5(trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ')) AS h, list_sort(list(doc_id)) AS ids, list_sort(list_distinct(list(source))) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1)
  SELECT h AS fingerprint, ids[1] AS keeper, len(ids) - 1 AS droppable, len(sources) AS sources FROM g""")
def duplicate_groups(t: Tables):
    """Groups of equal texts: which row stays, how many can go, over how many sources."""
    from ..functions.text import normalized

    g = t.documents.groupBy(F.md5(normalized(F.col("text")).cast("binary")).alias("fingerprint"))
    return g.agg(F.min("doc_id").alias("keeper"), (F.count("*") - 1).alias("droppable"), F.count_distinct("source").alias("sources")).where("droppable > 0")


@plan("snk01_shards", "SELECT event_id, event_type FROM events")
def shards(t: Tables):
    """Shards of bounded size, written whole by the commit protocol and read back."""
    out = f"{shared_dir(t.spark)}/tessella/shards-{uuid.uuid4().hex}"
    t.events.select("event_id", "event_type").write.option("maxRecordsPerFile", 2_000).parquet(out)
    return t.spark.read.parquet(out)


@plan("src07_traces", "SELECT count(*) FILTER (event_id % 5 NOT IN (0, 1)) AS kept, count(*) FILTER (event_id % 5 = 0) AS unreadable, count(*) FILTER (event_id % 5 = 1) AS foreign_rows FROM events")
def traces(t: Tables):
    """Rows of a trace file by schema: of ours, of another, and lines that can't be read."""
    out = f"{shared_dir(t.spark)}/tessella/traces-{uuid.uuid4().hex}"
    line = F.when(F.col("event_id") % 5 == 0, F.lit('{"schema": "t1", "id')).otherwise(F.to_json(F.struct(F.when(F.col("event_id") % 5 == 1, "other").otherwise("t1").alias("schema"), "event_id")))
    t.events.select(line.alias("value")).write.text(out)
    row = t.spark.read.text(out).select(F.try_parse_json("value").alias("v")).select(F.col("v").isNull().alias("bad"), F.try_variant_get("v", "$.schema", "string").alias("schema"))
    return row.agg(F.count_if(F.col("schema") == "t1").alias("kept"), F.count_if("bad").alias("unreadable"), F.count_if(~F.col("bad") & (F.col("schema") != "t1")).alias("foreign_rows"))


@plan("src10_found_files", "SELECT count(*) AS files FROM range(3)")
def found_files(t: Tables):
    """Files of a folder tree that a glob includes, each once."""
    out = f"{shared_dir(t.spark)}/tessella/tree-{uuid.uuid4().hex}"
    t.spark.range(3).repartitionByRange(3, "id").select(F.col("id").cast("string").alias("value"), "id").write.partitionBy("id").text(out)
    found = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(out)
    return found.select("path").distinct().agg(F.count("*").alias("files"))


@plan("ud01_adapters", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Q: ' || text WHEN 'assistant' THEN 'A: ' || text ELSE text END AS text FROM conversations")
def adapters(t: Tables):
    """Records adapted by a named function; a record without an adapter stays as it is."""
    known = {"user": lambda c: F.concat(F.lit("Q: "), c), "assistant": lambda c: F.concat(F.lit("A: "), c)}
    out = F.col("text")
    for name, adapt in known.items():
        out = F.when(F.col("role") == name, adapt(F.col("text"))).otherwise(out)
    return t.conversations.select("conv_id", "turn", out.alias("text"))


@plan("ud02_generated", "SELECT i AS doc_id, 'doc ' || md5('11:' || i) AS text FROM range(0, 500) r(i)")
def generated(t: Tables):
    """Documents of a seeded generator: each from its own number, so any partition makes the same."""
    return t.spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("doc "), F.md5(F.concat(F.lit("11:"), F.col("id").cast("string")).cast("binary"))).alias("text"))
