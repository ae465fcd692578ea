"""Kinds of pairs against the SQL on odd texts, and what meets when texts share a passage."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tessella import registry
from tessella.operators import overlap


def same(spark, path, rows):
    ids, texts = zip(*rows, strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), f"{path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = sorted(c.execute(f"SELECT lo, hi, kind FROM ({registry.oracle_sql()['dd13_pair_kinds']})").fetchall())
    assert sorted(map(tuple, registry.queries()["dd13_pair_kinds"](spark, str(path)).select("lo", "hi", "kind").collect())) == want
    return want


def test_kinds_equal_the_sql(spark, tmp_path):
    """Near copies of all degrees, parts of longer texts, copies, short, empty and null texts, a passage that many share."""
    draw = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["É", "straße", "ＡＢ", "x y"]
    passage = " ".join(draw.choice(words) for _ in range(30))
    rows, bases = [], [[draw.choice(words) for _ in range(draw.choice([3, 5, 8, 20, 60, 120]))] for _ in range(40)]
    for k in range(260):
        text = list(draw.choice(bases))
        if draw.random() < 0.5:
            for _ in range(draw.randrange(1, 6)):
                text[draw.randrange(len(text))] = draw.choice(words)
        if draw.random() < 0.3:
            text = text[draw.randrange(len(text)) :]
        if draw.random() < 0.3:
            text += [draw.choice(words) for _ in range(draw.randrange(80))]
        if draw.random() < 0.4:
            text.insert(draw.randrange(len(text) + 1), passage)
        rows.append((k * 3 - 50, draw.choice([" ", "\n", "\t\x0b"]).join(text).upper() if k % 4 else " ".join(text)))
    rows += [(1000 + k, x) for k, x in enumerate([None, None, "", " \n", "one", "ONE", "one two", passage, passage + " end", "\x1cone"])]
    kinds = [x[2] for x in same(spark, tmp_path, rows)]
    assert min(kinds.count(x) for x in ("exact", "near", "partial")) > 20
    same(spark, tmp_path, [(1, None), (2, None)])


def test_texts_that_share_a_passage_do_not_meet(spark, monkeypatch):
    """1,500 texts with 40 words in common and no wanted pair: before, each shingle of the passage made a million pairs."""
    met, cut = {}, overlap.cut

    def counted(df, label):
        found = cut(df, label)
        met[label] = found.count()
        return found

    monkeypatch.setattr(overlap, "cut", counted)
    passage = " ".join(f"p{k}" for k in range(40))
    df = spark.createDataFrame([(k, " ".join([*(f"t{k}a{x}" for x in range(60)), passage])) for k in range(1_500)], "doc_id long, text string")
    links = overlap.overlap_classes(df, "doc_id", 5, 0.55, 0.8)[1]
    assert links.count() == 0 and met["overlap-pairs"] < 1_500
