"""Each operator against brute force, a round trip or held-out accuracy, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import bpe_codec, hilbert_shards, html_tree, langid, lbl_lm, mixing, quality_forest, simhash, token_output, voronoi_knn
from tessella.llm.common import tokenizer_path
from tessella.llm.simple8b import pack, unpack
from tessella.sources.tables import load

DATA = "/root/testdata/sf0.001"
ODD = ["", "  a  b ", "a\n b", "it's  don't, we'll I'VE", "<|endoftext|> a<|startoftext|>B", "é à   b", "日本語 テスト, 12,3 4.5", "ΣΑΣ İstanbul", " \n ", "\x1c a\x1cb", "😀😀 👍🏽 hi!!??", "½ ² Ⅷ", "a" * 3000, "Straße. ça?| x"]
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, an extra column with a clashing name."""
    rows = [(i, x, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 1) for i, x in enumerate(ODD)]
    rows += [(None, None, None, None, None), (None, "the cat and the dog", "en", "s1", 2), (3, ODD[3], "en", "s0", 1), (3, ODD[3], "en", "s0", 1), (99, "word " * 20_000, "en", "s2", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return load(spark, DATA, "labels")


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 61, 5_000):
        for top in (0, 1, 300, 50_257, 2**32, 2**63):
            ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            assert (unpack(*pack(ids), n) == ids).all()


def test_token_output_reads_back_what_the_library_gives(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs = load(spark, DATA, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = sorted(token_output.token_output(docs).collect(), key=lambda r: r.start)
    crc = lambda t: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((r.doc_id, crc(r.text)) for r in docs.collect())
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
    assert token_output.token_output(empty).count() == 0


def test_bpe_equals_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    mine = bpe_codec.codec(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(1)
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for letters in ("ab", "the inga", "abcdefghijklmnopqrstuvwxyz'.,!#é ñüßà0123 \n😀日́") for _ in range(150)]
    for text in ODD + made:
        want = library.encode(text, add_special_tokens=False).ids
        got = mine.encode(text)
        assert [*map(int, got)] == want and mine.decode(got) == library.decode(want, skip_special_tokens=False)
    row = bpe_codec.bpe_digest(odd.where("doc_id is null and text is null")).first()
    assert (row.n_tokens, row.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe_codec.bpe_digest(odd).count() == odd.count() and bpe_codec.bpe_digest(empty).count() == 0


def test_language_of_held_out_documents(spark, odd, empty):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    got = langid.predict(docs, model).withColumn("out", langid.held_out()).join(docs.select("doc_id", "lang"), "doc_id").where("out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.98
    table = {r.doc_id: r for r in langid.predict(odd.where("doc_id is not null"), model).collect()}
    assert table[0].lang_pred == "und" and table[8].score == 0 and table[11].lang_pred == "und" and all(0 <= r.score <= 1 for r in table.values())
    assert langid.language_digest(empty).count() == 0 and langid.language_digest(odd).count() == odd.count()


def test_word_sums_equal_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    model = langid.Model(["x", "y"], {p: i for i, p in enumerate(pieces)}, np.random.default_rng(0).random((7, 2)), np.zeros(2))

    def every(word):
        if not word:
            return np.ones(2)
        out = sum((model.probs[model.pieces[word[:k]]] * every(word[k:]) for k in range(1, min(3, len(word)) + 1) if word[:k] in model.pieces), np.zeros(2))
        return out + (model.probs[6] * every(word[1:]) if word[0] not in model.pieces else 0)

    assert np.allclose(model.words(["abba", "ac", "b"]), [np.log(every("▁" + w)) for w in ("abba", "ac", "b")])


def plain_fingerprint(text):
    words = WORDS.findall((text or "").encode().translate(LOWER))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark, odd):
    for text in [*ODD, None] + [r.text for r in load(spark, DATA, "documents").limit(30).collect()]:
        assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_links_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(3)
    found = {int(x) for x in rng.integers(0, 2**63, 100, dtype=np.uint64)}
    for base in list(found)[:20]:
        for _ in range(40 if base % 2 else 8):
            x = base
            for k in rng.choice(40, rng.integers(1, 5), replace=False):
                x ^= 1 << int(k)
            found.add(x)
    fps = np.array(sorted(found), np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    edges = simhash.link_edges(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    got = {int(x): int(x) for x in fps.view(np.int64)}

    def top(x):
        while got[x] != x:
            x = got[x]
        return x

    for a, b in edges:
        got[max(top(a), top(b))] = min(top(a), top(b))
    groups = lambda f: {frozenset(k for k in range(len(fps)) if f(k) == r) for r in {f(k) for k in range(len(fps))}}
    signed = fps.view(np.int64).tolist()
    assert groups(root) == groups(lambda k: top(signed[k]))


def test_simhash_on_odd_tables(spark, odd, empty):
    got = simhash.simhash_digest(odd).collect()
    assert len(got) == odd.count() and all(len(r.fingerprint) == 16 for r in got)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {0} and simhash.simhash_digest(empty).count() == 0


def test_hilbert_curve_steps_by_one():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = cells[np.argsort(hilbert_shards.hilbert_index(cells, 3))]
    assert np.abs(np.diff(order, axis=0)).sum(1).max() == 1


def test_shards(spark, odd, empty):
    for docs in (odd, load(spark, DATA, "documents")):
        got = hilbert_shards.shard_documents(docs).collect()
        by = Counter(r.shard for r in got)
        assert len(got) == docs.count() and max(by.values()) - min(by.get(k, 0) for k in range(24)) <= 1
        for k in by:
            assert sorted(r.slot for r in got if r.shard == k) == list(range(by[k]))
        want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert hilbert_shards.shard_documents(empty).count() == 0


def plain_statistics(text):
    words = WORDS.findall((text or "").encode())
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x.encode())]
    return len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_statistics_and_verdicts(spark, odd, empty, labels):
    texts = [*ODD, None, "a b c d e a b c d e", "x y\nx y\n \nz"] + [r.text for r in load(spark, DATA, "documents").limit(60).collect()]
    for text in texts:
        assert quality_forest.base_statistics(text)[:5] == plain_statistics(text)
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    truth = load(spark, "/root/testdata/sf0.01", "labels")
    got = quality_forest.quality_digest(docs, truth).join(truth, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.98 and kept.get(0, 0) < 0.1
    assert quality_forest.quality_digest(odd, labels.where("false")).count() == odd.count() and quality_forest.quality_digest(empty, labels).count() == 0
    assert quality_forest.keep_good(odd, labels).columns == odd.columns


def test_pages(spark):
    tables = html_tree.train(html_tree.labelled_pages(200))
    good = bad = 0
    for tree in html_tree.labelled_pages(60, 77):
        for node, p in tables.marginals(tree):
            good, bad = good + ((p > 0.5) == bool(node.label)), bad + ((p > 0.5) != bool(node.label))
    assert good / (good + bad) > 0.9
    page = "<html><body><nav><ul><li><a href=x>home</a></li></ul></nav><article><h1>A &amp;amp; B</h1><p>Some  text,\n here.<p>More text.</article><footer>&copy; x</footer>"
    assert html_tree.extract(page, tables) == "A &amp; B Some text, here. More text."
    for broken in ("", "<", "<p", "<ul>" * 500, "<a href='>'>", "<script>x", "plain"):
        html_tree.extract(broken, tables)
    rows = spark.createDataFrame([(1, None, None, 3), (None, "u", "", 4), (2, "u", page, 5)], "page_id long, url string, html string, text long")
    assert {(r.page_id, r.n_chars) for r in html_tree.main_text(rows, tables).collect()} == {(1, 0), (None, 0), (2, 37)}


def test_message_passing_equals_enumeration():
    tree = html_tree.parse("<div class=ad>Buy now.</div><article><p>One, two.</p><ul><li><a href=x>y</a></li></ul></article>")
    tables = html_tree.train(html_tree.labelled_pages(40))
    order = [tree]
    for node in order:
        order += node.children
    weights = Counter()
    for states in np.ndindex(*[2] * len(order)):
        at = {id(n): s for n, s in zip(order, states, strict=True)}
        lp = tables.root[at[id(tree)]]
        for n in order:
            lp += sum(tables.seen.get(o, (0, 0))[at[id(n)]] for o in html_tree.observations(n))
            if n is not tree:
                lp += tables.step.get(html_tree.kind(n), tables.step["div"])[at[id(n.parent)]][at[id(n)]]
        for n in order:
            if not n.tag:
                weights[id(n), at[id(n)]] += math.exp(lp)
    for node, p in tables.marginals(tree):
        assert math.isclose(p, weights[id(node), 1] / (weights[id(node), 0] + weights[id(node), 1]), rel_tol=1e-6)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.3, 6).astype(float).tolist()) for i in range(300)] + [(400, [0.1] * 6), (401, [0.1] * 6), (400, [0.1] * 6)]
    odd = [(450, None), (500, [float("nan")] * 6), (501, [None] * 6), (502, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, voronoi_knn.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    ints = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for q, v in {i: v for i, v in ints if i % 50 == 0}.items():
        best = sorted(((-int(v @ w), i) for i, w in ints if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert voronoi_knn.top_k(df.where("false"), F.lit(True)).count() == 0


def test_language_model(spark, odd, empty):
    docs = load(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    got = lbl_lm.lm_digest(docs).collect()
    tokens = lambda t: [*WORDS.findall((t or "").encode().translate(LOWER)), b"\n"]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    texts = docs.collect()
    counts = Counter(w for r in texts if not out(r.doc_id) for w in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    base = Counter()
    for r in texts:
        w = tokens(r.text)
        base[r.doc_id, len(w), sum(x in counts for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == base
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.train_tokens == n for r in got)
    assert lbl_lm.lm_digest(empty).count() == 0


def test_language_model_is_normalised():
    counts = np.array([50, 20, 5])
    shared = np.zeros(lbl_lm.SHARED, np.int64)
    shared[lbl_lm.shared_class("rare")] = 5
    model = lbl_lm.Model(["a", "b", "\n"], counts, shared, (shared > 0) * 3, None, 80, 6).open()
    model.params = lbl_lm.first_params(model.class_counts())
    model.tables()
    p = np.exp(model.one[:, None, :] + model.two[None] - model.log_norm[..., None])
    assert np.allclose(p.sum(-1), 1, atol=1e-5)


def test_mix(spark, odd, empty):
    for docs in (odd, load(spark, "/root/testdata/sf0.01", "documents")):
        got = mixing.mix(docs).collect()
        assert len(got) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in got)
        total = sum(r.size for r in got)
        sources = {r.source: (r.source_size, r.target) for r in got}
        order = sorted(sources, key=lambda s: (s is None, s or ""))
        assert math.isclose(sum(t for _, t in sources.values()), 1.5 * total, rel_tol=1e-9)
        caps, weights, want = {s: 2.0 * sources[s][0] for s in order}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, {}
        rest = 1.5 * total
        free = set(order)
        while free:  # share, hold those above, share again
            level = rest / sum(weights[s] for s in free)
            above = {s for s in free if level * weights[s] > caps[s]}
            if not above:
                want |= {s: level * weights[s] for s in free}
                break
            want |= {s: caps[s] for s in above}
            rest -= sum(caps[s] for s in above)
            free -= above
        assert all(math.isclose(sources[s][1], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in order)
        for s in order:
            assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 1
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = load(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns
    assert corpus_pipeline.run(spark, DATA).count() > 0
