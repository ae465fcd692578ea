"""Rules that SQL can't express, against the same rule in Python, and graph operators on graphs made by hand."""

import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import graphs, prose, scores
from tessella.operators.folds import expanding_shares
from tessella.sources.tables import load

DATA = "/root/testdata/sf0.001"
ODD = [
    "", " \n\n\n\n a\t b \n c\x07​ ", "me@x.org, 192.168.0.1 and 2001:db8:0:0:1:2:3:4; +1 (555) 123-4567", "0x" + "ab" * 20 + " " + "ab" * 20 + " " + "aB3/" * 12 + "==",
    "sk-" + "a1" * 12 + " AKIA" + "B" * 16, "password = 'hunter2hunter2' token: " + "f3a9" * 10, "Café   x", "xoxb-1234567890-abc ghp_" + "a" * 36, None,
]


def texts(spark):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(1_000 + r.doc_id, r.text) for r in load(spark, DATA, "documents").collect()]
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)


def test_scrubbing_equals_the_shapes_in_python(spark):
    df, plain = texts(spark)
    for r in df.select("doc_id", X.scrubbed(F.col("text")).alias("x")).collect():
        want = plain[r.doc_id]
        for pattern, mark in X.PII:
            want = want if want is None else re.sub(pattern, mark, want)
        assert r.x == want


def test_canonical_text(spark):
    df, plain = texts(spark)
    for r in prose.composed(df).select("doc_id", X.canonical(F.col("text")).alias("x")).collect():
        want = plain[r.doc_id]
        if want is not None:
            kept = "".join(c for c in unicodedata.normalize("NFC", want) if c in "\n\t" or unicodedata.category(c)[0] != "C")
            want = re.sub(r"\n{3,}", "\n\n", re.sub(" \n", "\n", re.sub(r"[^\S\n]+", " ", kept))).strip()
        assert r.x == want


def test_redaction(spark):
    df, plain = texts(spark)
    for r in prose.redacted(df.where("text IS NOT NULL")).collect():
        want, counts = plain[r.doc_id], Counter()
        for name, pattern, mark in X.REDACTIONS:
            want, counts[name] = re.subn(pattern, mark.replace("$1$2", r"\1\2"), want)

        def long_token(m):
            secret = prose._bits(m[0]) >= X.LONG_ENTROPY and not m[0].isalpha()
            counts["long_token"] += secret
            return "[SECRET]" if secret else m[0]

        assert r.text == re.sub(X.LONG_TOKEN, long_token, want)
        assert all(r[k] == counts[k] for k in [*(n for n, _, _ in X.REDACTIONS), "long_token"])


def test_secrets_own_their_span():
    aws = "AKIA" + "Q" * 16
    assert [x[1] for x in prose.line_secrets(f"token = {aws}")] == ["aws-access-key-id"]
    assert prose.line_secrets(f"token = {aws}", frozenset({"aws-access-key-id"})) == []  # allowed, and nothing else takes the span
    assert prose.line_secrets("password: aaaaaaaaaaaaaaaa") == []  # under the entropy of its rule
    (col, rule, bits, mark, shown), = prose.line_secrets("x api_key='Zx9Qw3Er5Ty7Ui1O'")
    assert (col, rule, shown) == (12, "generic-api-key", "Zx9Q…(16 chars)") and bits == 4.0 and prose.line_secrets("x api_key='Zx9Qw3Er5Ty7Ui1O'", frozenset({mark})) == []


def test_expanding_shares(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(values)], "g long, i long, x double")
    got = {r.i: (r.seen, r.share) for r in expanding_shares(df, "g", ["i"], "x", "i").collect()}
    for i, x in enumerate(values):
        below = sum(v < x for v in values[:i]) + sum(v == x for v in values[:i]) / 2
        assert got[i][0] == i and (i == 0 or abs(got[i][1] - below / i) < 1e-12)


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (6, 1), (7, 8), (None, 1), (1, 2)]
    got = {r.node: r.component for r in graphs.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert graphs.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_communities_of_two_cliques(spark):
    clique = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    df = spark.createDataFrame([*clique([1, 2, 3, 4]), *clique([11, 12, 13, 14]), (4, 11)], "src long, dst long")
    got = {r.node: r.community for r in graphs.communities(df, 6).collect()}
    assert len({got[k] for k in (1, 2, 3)}) == len({got[k] for k in (12, 13, 14)}) == 1 and got[1] != got[12]


def test_logistic_fit_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + 1.2 * x[:, 0] - 0.7 * x[:, 1])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    m, w = np.column_stack([np.ones(400), x]), np.zeros(3)
    for _ in range(5):
        p = 1 / (1 + np.exp(-m @ w))
        w = w + np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m / 400 + 1e-3 * np.eye(3), m.T @ (y - p) / 400 - 1e-3 * w)
    assert np.allclose(scores.fit_logistic(df, ["a", "b"], "y", 5), w)
