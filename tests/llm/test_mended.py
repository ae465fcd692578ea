"""Cases that once went wrong: equal rows, clashing names, broken pages, all words and pieces, bounds of the Voronoi join."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import hilbert_shards, html_tree, langid, lbl_lm, mixing, quality_forest, token_output, voronoi_knn
from tessella.llm.common import Memory, byte_slices, parted, tokenizer_path


def test_equal_rows_each_have_their_own_copies(spark):
    rows = [(1, "a b c d e f", "s", 1, 2, 3, 4)] * 100 + [(None, "x y", "s", 1, 2, 3, 4)] * 50 + [(2, "q " * 40, None, 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, rows int, copy int, h0 int")
    mixed = mixing.mixed_documents(docs)
    words = mixed.agg(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert mixed.columns == docs.columns and words == mixing.mix(docs, whole=True).agg(F.sum("taken")).first()[0]
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def test_equal_rows_are_spread_over_shards(spark, tmp_path):
    docs = spark.createDataFrame([(1, "same", 5, 6, 7)] * 48 + [(None, None, 1, 2, 3)] * 24, "doc_id long, text string, at int, k int, c int")
    found = spark.read.parquet(hilbert_shards.write_shards(docs, str(tmp_path / "out")))
    by = Counter(r[0] for r in found.select("__shard").collect())
    assert set(by.values()) == {3} and len(by) == 24 and {"at", "k", "c"} <= set(found.columns)


@pytest.mark.parametrize("piece", ["<p", "<b", '<a href="', "<a 'x ", '<a ">"', "<svg>", "<script>", "<b>", "</i>", "<!--", "</script", "<head>", "<div></b>"])
def test_broken_pages_are_read_in_linear_time(piece):
    start = time.process_time()
    html_tree.parse(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 10


def test_words_that_stay_in_a_page():
    tables = html_tree.train(html_tree.labelled_pages(200))
    assert html_tree.extract("<p>The area is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> metres", tables) == "The area is x=2 metres"
    article = "<article><p>Some article text, with words. And more of it here.</article>"
    for start in ("<head><title>t</title>", "<html><head><meta x><body>", "<select><option>a", "<textarea>"):
        assert "Some article text" in html_tree.extract(start + article, tables)


def test_expected_pieces_equal_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "abba"]
    rng = np.random.default_rng(1)
    model = langid.Model(["x", "y"], {p: i for i, p in enumerate(pieces)}, rng.random((8, 2)), np.zeros(2))
    words, weights = ["abba", "ac", "b"], rng.random((3, 2))

    def every(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in model.pieces:
                yield from ([model.pieces[word[:k]], *rest] for rest in every(word[k:]))
        if word and word[0] not in model.pieces:
            yield from ([7, *rest] for rest in every(word[1:]))

    want = np.zeros((8, 2))
    for word, weight in zip(words, weights, strict=True):
        ways = [(way, np.prod(model.probs[way], axis=0)) for way in every("▁" + word)]
        total = sum(p for _, p in ways)
        for way, p in ways:
            for piece in way:
                want[piece] += weight * p / total
    assert np.allclose(model.lattice(words).expected(model.probs, weights), want)


def test_scores_are_posteriors():
    model = langid.fit_counts({"x": Counter(aa=5, ab=1), "y": Counter(bb=5, ab=1)}, Counter(x=1, y=3), ["▁", "a", "b"])
    for text in ("aa", "ab bb aa", "aa " * 9):
        logs = model.prior + sum(model.words(langid.words_of(text)))
        share = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        ((lang, score, _),) = model.texts([text])
        assert lang == model.langs[int(share.argmax())] and np.isclose(score, share.max())


def test_known_languages_stay(spark):
    docs = spark.createDataFrame([(1, "the cat", "en", 1), (2, None, "en", 2), (3, "", None, 3), (None, "12 3", "en", 4), (4, "the dog", "en", 5), (4, "the dog", "en", 5)], "doc_id long, text string, lang string, score int")
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["the cat", "the dog", "the dog"]
    assert langid.keep_known(docs.where("false")).count() == 0 and langid.keep_known(docs.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_every_word_has_a_class_and_a_share():
    words = [f"w{i}" for i in range(lbl_lm.OWN)] + ["rare", "care"]
    counts, k = np.arange(len(words), 0, -1) + 5, lbl_lm.shared_class("rare")
    tokens, types = np.zeros(lbl_lm.SHARED, np.int64), np.zeros(lbl_lm.SHARED, np.int64)
    tokens[k], types[k] = counts[-2:].sum(), 2  # both end alike
    model = lbl_lm.Model(words, counts, tokens, types, None, int(counts.sum()), len(words)).open()
    texts = ["w0", "rare", "care", "bare"]
    classes = model.classes_of(texts, model.ids(texts))
    assert classes.tolist() == [0, lbl_lm.OWN + k, lbl_lm.OWN + k, lbl_lm.OWN + k]
    shares = 10 ** (model.log_count[model.ids(texts[1:])] - model.log_shared[classes[1:]])
    assert np.isclose(shares.sum(), 1)  # two words that occur and one share for all that don't


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (20, 16))
    points = np.floor(256 * np.concatenate([c + rng.normal(0, 0.05, (50, 16)) for c in centres / np.linalg.norm(centres, axis=1, keepdims=True)]))
    pivots = voronoi_knn.fit_pivots(points, 20)
    cell, radius = voronoi_knn.nearest(points, pivots)
    radii = np.array([radius[cell == c].max(initial=-1) for c in range(len(pivots))])
    longest = np.array([(points[cell == c] ** 2).sum(1).max(initial=-1) for c in range(len(pivots))])
    queries = points[::25]
    bound, score = voronoi_knn.reach(queries, pivots, radii, longest), queries @ points.T
    visits = []
    for q in range(len(queries)):
        fifth = np.sort(score[q])[-6]
        for c in np.unique(cell):
            assert score[q][cell == c].max() <= bound[q, c] * (1 + 1e-9) + 1e-6
        visits.append(np.mean([bound[q, c] >= fifth for c in np.unique(cell)]))
    assert np.mean(visits) < 0.5


def test_forest_paths_and_threshold(spark):
    rng = np.random.default_rng(6)
    points = np.clip(rng.normal(0.3, 0.03, (400, 9)), 0, 1)
    forest = quality_forest.grow(points, trees=40)
    for tree in range(3):  # the path of a point, followed by hand
        for p in points[:20]:
            at = 0
            while (below := forest.child[tree][at]) != at:
                at = below + (p[forest.feature[tree][at]] >= forest.cut[tree][at])
            flat = np.zeros(1, np.int64)
            for _ in range(forest.depth):
                step = forest.child[tree][flat]
                flat = step + ((p[forest.feature[tree][flat]] >= forest.cut[tree][flat]) & (step != flat))
            assert flat[0] == at
    assert forest.score(np.full((1, 9), 0.95)) > forest.score(points).max()


def test_slices_and_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "b" * 10, "", "c" * 200])], names=["text"])
    assert [x.num_rows for x in byte_slices([batch], "text", 60)] and sum(x.num_rows for x in byte_slices([batch], "text", 60)) == 5
    pieces, places, starts = parted(["a b a", "", " a"])
    got = pieces.to_pylist()
    assert [[got[k] for k in places[a:b]] for a, b in zip(starts, starts[1:], strict=False)] == [["a", "b", "a"], [""], ["", "a"]]
    asked = []
    memory = Memory(lambda x: asked.append(x) or x, 2)
    assert [memory[x] for x in "abacadae"] == [*"abacadae"] and asked.count("a") == 1 and len(memory) <= 2


def test_long_and_odd_texts_have_the_library_s_ids():
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), token_output.PieceEncoder(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["".join(rng.choice(x) for _ in range(rng.randint(0, 80))) for x in ("ab .", "the inga'sdmt ", " \n\n\t a.'s", "ſŁ×÷ªº²½ \x1c\x85\xa0 x", "a1.'-é# ") for _ in range(200)]
    texts += ["", "<|endoftext|> a", "word " * 40_000]
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
