"""Stars, turns, buffers and blobs on small cases by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators.similarity import jaccard_classes, jaccard_join, star_survivors
from tessella.operators.turns import shuffle_buffer, smooth_turns
from tessella.sources import readers, sinks


def one_by_one(edges):
    near, owner = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for x in sorted(near):
        owner[x] = min((y for y in near[x] if y < x and owner.get(y) == y), default=x)
    return owner


def test_stars_equal_the_walk_over_ids(spark):
    draw = random.Random(3)
    drawn = {tuple(sorted(draw.sample(range(40), 2))) for _ in range(60)}
    for edges in ([(1, 2), (2, 3), (3, 4), (4, 5), (1, 2)], [(1, 9), (2, 9), (2, 3)], sorted(drawn)):
        got = {r.id: r.survivor for r in star_survivors(spark.createDataFrame(edges, "lo long, hi long")).collect()}
        assert got == one_by_one(edges)
    assert star_survivors(spark.createDataFrame([], "lo long, hi long")).count() == 0


def test_equal_sets_are_one_class(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text) for i in range(1, 9)] + [(20, text + " tail"), (30, ""), (31, None), (40, "other words than those before")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members, links = jaccard_classes(df, "doc_id", 5, 0.8)
    assert {r.id: r.head for r in members.collect()} == {**dict.fromkeys(range(1, 9), 1), 20: 20, 30: 30, 40: 40}
    assert [(r.lo, r.hi) for r in links.collect()] == [(1, 20)]
    assert jaccard_join(df, "doc_id", 5, 0.8).count() == 9 * 8 // 2


def test_smooth_turns(spark):
    assert [r.source for r in smooth_turns(spark, {"a": 5, "b": 1, "c": 1}).orderBy("turn").collect()] == list("aabacaa")
    with pytest.raises(ValueError):
        smooth_turns(spark, {"a": 0})


def test_shuffle_buffer(spark):
    df = spark.range(0, 500, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.col("id") + (1 << 60)).alias("big"))
    got = [tuple(r) for r in shuffle_buffer(df, 16, 5).collect()]
    assert got == [tuple(r) for r in shuffle_buffer(df, 16, 5).collect()] and got != sorted(got)
    assert sorted(got) == [tuple(r) for r in df.collect()] and all(x <= place + 16 for place, (x, _) in enumerate(got))
    assert shuffle_buffer(df.where("id < 0"), 16, 5).count() == 0


def test_packed_ids(spark):
    rows = [(1, [0, 1, 255, 256, 65_535]), (2, []), (3, None), (4, [7])]
    df = spark.createDataFrame(rows, "id int, ids array<int>")
    packed = sinks.pack_ids(df)
    assert bytes(packed.where("id = 1").first().bin) == b"".join(x.to_bytes(2, "little") for x in rows[0][1])
    assert {r.id: r.ids for r in readers.unpack_ids(packed).collect()} == dict(rows)
    with pytest.raises(Exception, match="16 bits"):
        sinks.pack_ids(spark.createDataFrame([(1, [65_536])], "id int, ids array<int>")).collect()


def test_bitmaps(spark):
    df = spark.createDataFrame([("a", bytearray(b"\x01\x80")), ("b", bytearray()), ("c", None)], "k string, bitmap binary")
    assert sorted(tuple(r) for r in readers.bitmap_lines(df).collect()) == [("a", 0), ("a", 15)]


def test_cobertura_of_odd_reports(spark):
    line = '<class filename="f"><lines><line number="3" hits="2"/><line number="3" hits="1"/></lines></class>'
    good = f'<coverage lines-valid="4" lines-covered="1"><packages><package><classes>{line}{line}</classes></package></packages></coverage>'
    lines, totals = readers.read_cobertura(spark.createDataFrame([(good,), ("<coverage/>",), ("",), (None,)], "xml string"))
    assert [tuple(r) for r in lines.collect()] == [("f", 3, 6)] and (4, 1) in [tuple(r) for r in totals.collect()]


def test_bookmarks_of_odd_pages(spark):
    html = '<DT><a href="u&amp;v" tags=" a, ,b" add_date="x">T &lt;<b>i</b></a><A HREF="">none</A>'
    got = readers.read_bookmarks(spark.createDataFrame([(html,), ("",), (None,)], "html string")).collect()
    assert [tuple(r) for r in got] == [("u&v", "T <i", ["a", "b"], None)]
