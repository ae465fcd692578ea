"""The pipeline's near-duplicate stage against all pairs by brute force."""

import random

import numpy as np
import pytest

from tessella.llm import near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def kept_by_all_pairs(rows):
    """The smallest id of each component of all pairs of similarity 0.8 or more."""
    sets, root = {i: shingles(x) for i, x in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            shared = len(sets[i] & sets[j])
            if i < j and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in root if top(i) == i}


@pytest.fixture(scope="module")
def planted():
    """Texts with near copies on both sides of the limit, groups of copies, one passage in all, and short texts."""
    rng, vocabulary = random.Random(3), [f"w{i}" for i in range(4_000)]
    passage, texts = rng.choices(vocabulary, k=30), []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(40, 300))
        texts.append(words + passage)
        for _ in range(rng.randint(1, 4)):
            copy = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(0, len(copy) // 35)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy[: rng.randint(int(len(copy) * 0.9), len(copy))])
    rng.shuffle(texts)
    texts = [" ".join(x) for x in texts] + ["", " ", "a b", "A  b", "a b c d e f g h", "a b c d e f g h i"]
    return list(enumerate(texts))


# Without the first step nothing is joined beforehand, so the prefixes alone must find all; with them, most is joined.
@pytest.mark.parametrize("prints", [True, False])
def test_kept_documents_equal_all_pairs(spark, planted, monkeypatch, prints):
    if not prints:
        monkeypatch.setattr(near_copies, "first_pairs", lambda classes: spark.createDataFrame([], "lo long, hi long"))
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_one_of_near(docs).collect()} == kept_by_all_pairs(planted)


def test_pipeline_stage_drops_a_copy_that_fingerprints_miss(spark, planted):
    import corpus_pipeline
    from tessella.llm.simhash import fingerprint

    rng = random.Random(8)
    words = [f"w{rng.randrange(4_000)}" for _ in range(200)]
    near = list(words)
    for k in (30, 90, 150):
        near[k] = "changed"
    texts = [" ".join(words), " ".join(near)]
    assert int(np.bitwise_count(np.int64(fingerprint(texts[0])).view(np.uint64) ^ np.int64(fingerprint(texts[1])).view(np.uint64))) > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()] == [0]


def test_odd_rows(spark):
    rows = [(None, None, 1), (None, "", 2), (3, "x y", 3), (3, "x y", 4), (3, "other", 5), (None, "alone here", 6), (None, "x  Y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size long")
    kept = near_copies.keep_one_of_near(docs)
    assert kept.columns == docs.columns and sorted((r.text or "").lower() for r in kept.collect()) == ["", "alone here", "other", "x y"]
    assert near_copies.keep_one_of_near(docs.where("false")).count() == 0
