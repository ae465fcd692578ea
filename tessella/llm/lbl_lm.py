"""Scoring texts by a log-bilinear neural language model that is trained in numpy by noise-contrastive estimation.

The model predicts a class after the two words before, and the word inside its class. A class's score is (C1 r1 + C2 r2) . q
+ b. The most frequent words of the training documents are a class each; the others are classed by their ending, so every word
has a vector, and inside a class a word has its share of the training counts. The score is a sum of a term of each context
word, so the normaliser of every pair of contexts is one entry of a product of two matrices, and token log-probabilities are
exact look-ups.

Training covers every position of every training document: a start on a bounded sample of documents, then each task goes on
from it over its own documents and the tasks' parameters are averaged by the number of positions that they saw. So scores
depend a little on how the documents are dealt out to tasks; the base scores don't. Counts cover all tokens. Words with many
occurrences are looked up in a bounded table; the rest meet their counts in a join.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .common import Memory, slices, worker_state

#: Words that are a class each, classes of the other words, characters of the ending that these go by, the vectors' length.
OWN, SHARED, ENDING, SIZE = 1_500, 500, 2, 32
#: Words of the look-up table, at most; longer ones are joined.
TABLE, TABLE_BYTES = 250_000, 128
#: Documents of the start, about; passes over them.
START_DOCS, START_PASSES = 800, 2
BATCH, NOISE, RATE, SEED = 2_048, 32, 0.1, 11
#: Distinct words that a counting task holds before it hands them on.
HELD = 200_000
END = "\n"
_PLAIN = bytes.maketrans(bytes([*range(65, 91), *range(9, 14)]), bytes([*range(97, 123), *[32] * 5]))


def words_of(text: str | None) -> list[str]:
    """The words of a text, A-Z in lower case, and the end."""
    words = (text or "").encode().translate(_PLAIN).decode().split(" ")
    if "" in words:
        words = [x for x in words if x]
    words.append(END)
    return words


def shared_class(word: str) -> int:
    """The class of a word that has none of its own, from 0 to SHARED - 1."""
    return zlib.crc32(word[-ENDING:].encode()) % SHARED


def held_out() -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 7, is 2. A null id is as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        keys, values = list(found), list(found.values())
        found.clear()
        for at in range(0, len(keys), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 20_000], pa.string()), pa.array(values[at : at + 20_000], pa.int64())], names=["token", "n"])

    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            found.update(words_of(text))
        if len(found) > HELD:
            yield from out()
    yield from out()


@dataclass
class Params:
    """R: context vectors (a row for the start of a text too); C: a matrix for each place; Q, b: target vectors and biases."""

    R: np.ndarray
    C: np.ndarray
    Q: np.ndarray
    b: np.ndarray

    def flat(self) -> np.ndarray:
        """All parameters as rows of SIZE numbers."""
        bias = np.zeros(-(-len(self.b) // SIZE) * SIZE, np.float32)
        bias[: len(self.b)] = self.b
        return np.concatenate([self.R, self.C.reshape(-1, SIZE), self.Q, bias.reshape(-1, SIZE)])

    @staticmethod
    def of(rows: np.ndarray, classes: int) -> Params:
        rows = rows.astype(np.float32)
        a, c = classes + 1, classes + 1 + 2 * SIZE
        return Params(rows[:a], rows[a:c].reshape(2, SIZE, SIZE), rows[c : c + classes], rows[c + classes :].reshape(-1)[:classes])


def first_params(counts: np.ndarray, seed: int = SEED) -> Params:
    """Small random vectors; the biases are the classes' log shares of all training tokens."""
    rng, n = np.random.default_rng(seed), len(counts)
    small = lambda rows: rng.normal(0, 0.1, (rows, SIZE)).astype(np.float32)
    share = np.log((counts + 1.0) / (counts.sum() + n)).astype(np.float32)
    return Params(small(n + 1), np.stack([np.eye(SIZE, dtype=np.float32)] * 2), small(n), share)


class Trainer:
    """Noise-contrastive estimation by Adagrad: a batch shares its noise words, so its scores are matrix products."""

    def __init__(self, params: Params, counts: np.ndarray, seed: int = SEED):
        self.p, self.rng, self.seen = params, np.random.default_rng(seed), 0
        noise = (counts + 1.0) ** 1.0
        self.noise = noise / noise.sum()
        self.cum = np.cumsum(self.noise)
        self.log_noise = np.log(NOISE * self.noise).astype(np.float32)
        self.sums = [np.full(x.shape, 0.1, np.float32) for x in (params.R, params.C, params.Q, params.b)]

    @staticmethod
    def _groups(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of ``rows`` (below n) by number, where each number begins in it, and the numbers."""
        rows = rows.astype(np.uint16 if n < 1 << 16 else np.int64)
        order = np.argsort(rows, kind="stable")  # of few bits: by radix
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        return order, first, rows[first].astype(np.intp)

    @staticmethod
    def _step(x: np.ndarray, total: np.ndarray, groups: tuple[np.ndarray, np.ndarray, np.ndarray], grad: np.ndarray) -> None:
        """Adagrad on the rows of ``groups``; rows that occur more than once add up."""
        order, first, rows = groups
        grad = np.add.reduceat(grad[order], first, axis=0)
        total[rows] += grad * grad
        x[rows] += RATE * grad / np.sqrt(total[rows])

    def batch(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), len(p.b) - 1)
        r1, r2 = p.R[c1], p.R[c2]
        h = r1 @ p.C[0] + r2 @ p.C[1]
        q, qn = p.Q[w], p.Q[noise]
        good = (h * q).sum(1) + p.b[w] - self.log_noise[w]
        bad = h @ qn.T + p.b[noise] - self.log_noise[noise]
        # Of the log-likelihood of telling words from noise; a mean over the batch would starve rare rows under Adagrad.
        g = 1 / (1 + np.exp(np.clip(good, -30, 30)))
        gn = np.negative(bad, out=bad)
        np.exp(np.clip(gn, -30, 30, out=gn), out=gn)
        np.divide(-1, np.add(gn, 1, out=gn), out=gn)
        dh = g[:, None] * q + gn @ qn
        dq, dqn = g[:, None] * h, gn.T @ h
        d1, d2 = dh @ p.C[0].T, dh @ p.C[1].T
        dC = np.stack([r1.T @ dh, r2.T @ dh]) / len(w)
        targets = self._groups(np.concatenate([w, noise]), len(p.Q))
        self._step(p.Q, self.sums[2], targets, np.concatenate([dq, dqn / 8]))
        self._step(p.b, self.sums[3], targets, np.concatenate([g, gn.sum(0) / 8]))
        self._step(p.R, self.sums[0], self._groups(np.concatenate([c1, c2]), len(p.R)), np.concatenate([d1, d2]))
        self.sums[1] += dC * dC
        p.C += 0.1 * RATE * dC / np.sqrt(self.sums[1])
        self.seen += len(w)

    def run(self, triples: np.ndarray) -> None:
        """Over (first context, second context, word) rows, in a random order."""
        columns = np.ascontiguousarray(triples.T)[:, self.rng.permutation(len(triples))]
        for at in range(0, len(triples), BATCH):
            self.batch(*columns[:, at : at + BATCH])


def triples_of(classes: list[np.ndarray], start: int) -> np.ndarray:
    """Rows (word before, word before that, word) of every position of texts of classes."""
    if not classes:
        return np.zeros((0, 3), np.int64)
    padded = np.concatenate([x for c in classes for x in ((start, start), c)])
    lengths = np.array([len(c) + 2 for c in classes])
    inside = np.ones(len(padded), bool)
    at = np.cumsum(lengths) - lengths
    inside[at] = inside[at + 1] = False
    place = np.flatnonzero(inside)
    return np.column_stack([padded[place - 1], padded[place - 2], padded[place]])


@dataclass
class Model:
    """The look-up table (words by falling count), tokens and types of the shared classes, the parameters and the totals of
    the training tokens."""

    words: list[str]
    counts: np.ndarray
    shared_tokens: np.ndarray
    shared_types: np.ndarray
    params: Params
    tokens: int
    types: int

    def __post_init__(self):
        self.own = min(OWN, len(self.words))
        self.classes = self.own + SHARED
        self.index: dict[str, int] | None = None

    def __reduce__(self):
        return Model, (self.words, self.counts, self.shared_tokens, self.shared_types, self.params, self.tokens, self.types)

    def class_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.own], self.shared_tokens]).astype(float)

    def open(self) -> Model:
        """Build what is looked up: the index and the tables of log-probabilities."""
        if self.index is None:
            self.index = {w: i for i, w in enumerate(self.words)}
            self.log_count = np.append(np.log10(self.counts + 1.0), 0.0)
            # In a shared class a word has (c + 1) of the class's sum of (c + 1), and one share is for all that never occurred.
            self.log_shared = np.append(np.zeros(self.own), np.log10(self.shared_tokens + self.shared_types + 1.0))
            own = np.arange(self.own)
            # The last entry stands for the words outside, at -1, until they are classed.
            self.class_table = np.concatenate([own, [self.own + shared_class(w) for w in self.words[self.own :]], [0]]).astype(np.int64)
            self.endings = Memory(shared_class, 100_000)
            self.log_all = float(np.log10(self.tokens + self.types + 1.0))
        return self

    def tables(self) -> None:
        """The terms of both context words for every class, and the normalisers of all pairs of contexts."""
        if not hasattr(self, "log_norm"):
            p = self.params
            one = (p.R @ p.C[0]) @ p.Q.T + p.b
            two = (p.R @ p.C[1]) @ p.Q.T
            top1, top2 = one.max(1, keepdims=True), two.max(1, keepdims=True)
            norm = np.exp(one - top1) @ np.exp(two - top2).T
            self.one, self.two = one - top1, two - top2
            self.log_norm = np.log(np.maximum(norm, 1e-37))

    def ids(self, words: list[str]) -> np.ndarray:
        """Places in the look-up table; -1 for words outside."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def token_log10(self, classes: list[np.ndarray]) -> np.ndarray:
        """Log10-probability of every position's class, the texts one after another."""
        self.tables()
        c1, c2, w = triples_of(classes, self.classes).T
        return (self.one[c1, w] + self.two[c2, w] - self.log_norm[c1, c2]).astype(np.float64) / np.log(10)

    def classes_of(self, words: list[str], ids: np.ndarray) -> np.ndarray:
        """The class of every word of a text."""
        found = self.class_table[ids]
        outside = np.flatnonzero(ids < 0)
        found[outside] = [self.own + self.endings[words[k][-ENDING:]] for k in outside.tolist()]
        return found


def _class_totals(own: frozenset[str]):
    """For each shared class the tokens and types of some counts (token, n) that aren't a class of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
        for batch in batches:
            for token, n in zip(batch.column("token").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), strict=True):
                if token not in own:
                    k = shared_class(token)
                    tokens[k] += n
                    types[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(SHARED), pa.int32()), pa.array(tokens), pa.array(types)], names=["class", "tokens", "types"])

    return run


def _opened(key: str, shared) -> Model:
    return worker_state(key, lambda: shared.value.open())


def _train(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = _opened(key, shared)
        p = model.params
        mine = Params(p.R.copy(), p.C.copy(), p.Q.copy(), p.b.copy())
        trainer = Trainer(mine, model.class_counts(), SEED + TaskContext.get().partitionId())
        for batch in slices(batches):
            texts = [words_of(x) for x in batch.column("text").to_pylist()]
            trainer.run(triples_of([model.classes_of(x, model.ids(x)) for x in texts], model.classes))
        if trainer.seen:
            rows = mine.flat()
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), SIZE).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([trainer.seen] * len(rows), pa.int64()), values], names=["row", "seen", "v"])

    return run


def _classes(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _opened(key, shared)
        for batch in slices(batches):
            texts = [words_of(x) for x in batch.column("text").to_pylist()]
            ids = [model.classes_of(x, model.ids(x)).astype("<i4").tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    return run


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training documents of ``docs`` and the table (token, n) of all their tokens."""
    spark = docs.sparkSession
    training = docs.where(~held_out()).select("doc_id", "text")
    counted = training.select("text").mapInArrow(_count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = cut(counted, "lm-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    step = F.floor(F.log2("n") * 16).cast("int")
    short = F.octet_length("token") <= TABLE_BYTES
    floor, room = None, TABLE
    for bucket, size in counts.where(short).groupBy(step.alias("b")).count().orderBy(F.desc("b")).collect():  # at most 16 a bit of a count
        room -= size
        if room < 0:
            break
        floor = bucket
    table = counts.where(short & (step >= floor)).toArrow().to_pydict() if floor is not None else {"token": [], "n": []}
    order = sorted(range(len(table["n"])), key=lambda i: (-table["n"][i], table["token"][i]))
    words, n = [table["token"][i] for i in order], np.array([table["n"][i] for i in order], np.int64)
    totals = counts.mapInArrow(_class_totals(frozenset(words[:OWN])), "class int, tokens long, types long").groupBy("class").agg(F.sum("tokens"), F.sum("types")).collect()
    sums = np.zeros((2, SHARED), np.int64)
    for k, a, b in totals:
        sums[:, k] = a, b
    model = Model(words, n, *sums, None, *map(int, total))
    classes = model.class_counts()
    model.params = first_params(classes)
    if not words:
        return model, counts
    rate = min(1.0, START_DOCS / max(int(n[words.index(END)]) if END in words else 1, 1))
    sample = training.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    opened = spark.sparkContext.broadcast(model)  # bounded by TABLE words and the parameters
    texts = [np.frombuffer(r[0], "<i4").astype(np.int64) for r in sample.mapInArrow(_classes(uuid.uuid4().hex, opened), "ids binary").collect()]
    trainer = Trainer(model.params, classes)
    for _ in range(START_PASSES):
        trainer.run(triples_of(texts, model.classes))
    shared = spark.sparkContext.broadcast(model)
    tuned = training.mapInArrow(_train(uuid.uuid4().hex, shared), "row int, seen long, v array<float>")
    mean = [(F.sum(F.col("v")[k] * F.col("seen")) / F.sum("seen")).alias(f"v{k}") for k in range(SIZE)]
    rows = tuned.groupBy("row").agg(*mean).toArrow().to_pandas().sort_values("row")  # a row of parameters each
    if len(rows):
        model.params = Params.of(rows[[f"v{k}" for k in range(SIZE)]].to_numpy(), len(classes))
    return model, counts


SCORED = "row_id long, doc_id long, n_tokens long, table_known long, base_log double, lm_log double, n_others long, rest array<struct<token:string,n:long>>"


def _score(key: str, shared):
    rest_type = pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, row = _opened(key, shared), TaskContext.get().partitionId() << 33
        for batch in slices(batches, 64):
            texts = [words_of(x) for x in batch.column("text").to_pylist()]
            if not texts:
                continue
            ids = [model.ids(x) for x in texts]
            rest = [[{"token": t, "n": n} for t, n in Counter([x[k] for k in np.flatnonzero(y < 0).tolist()]).items()] for x, y in zip(texts, ids, strict=True)]
            every = np.concatenate(ids)
            at = np.cumsum([0, *(len(x) for x in ids[:-1])])
            outside = (every < 0) | (every >= model.own)
            base = model.log_count[every]  # -1 is the last entry, which is zero
            classes = [model.classes_of(x, y) for x, y in zip(texts, ids, strict=True)]
            lm = model.token_log10(classes) + np.where(outside, base - model.log_shared[np.concatenate(classes)], 0)
            sums = [np.add.reduceat(x, at) for x in (np.ones(len(every), np.int64), (every >= 0).astype(np.int64), base, lm, outside.astype(np.int64))]
            rows = pa.array(range(row, row + len(texts)), pa.int64())
            row += len(texts)
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id").cast(pa.int64()), *map(pa.array, sums), pa.array(rest, rest_type)], names=["row_id", "doc_id", "n_tokens", "table_known", "base_log", "lm_log", "n_others", "rest"])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    scored = cut(docs.select("doc_id", "text").mapInArrow(_score(uuid.uuid4().hex, shared), SCORED), "lm-scored")
    rest = scored.select("row_id", F.explode("rest").alias("x")).select("row_id", "x.token", F.col("x.n").alias("times"))
    met = rest.join(counts, "token").groupBy("row_id").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    log_all = float(np.log10(model.tokens + model.types + 1.0))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rest").join(met, "row_id", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("table_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base_log") + more - F.col("n_tokens") * log_all).alias("base_score"), (F.col("lm_log") + more).alias("score"),
    )


def lm_digest(docs: DataFrame) -> DataFrame:
    """The scores of all ``docs`` (doc_id, text) by a model of those that aren't held out.

    A null or empty text is its end alone; a null doc_id is kept and learned from; repeated rows count and score each by
    itself; without a training document every token is unseen, N and V are 0 and the model knows one class; an empty table
    gives no rows; other columns are ignored.
    """
    return score(docs, *fit(docs))
