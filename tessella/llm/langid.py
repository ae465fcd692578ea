"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece; the probability of a
word is the sum over all its segmentations into pieces, by a forward pass over its characters for all languages at once. A
text is the product of its words. The probabilities are learned by expectation maximisation with the matching backward
pass, from the word counts of labelled documents.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, tokenizer_path, worker_state

#: Labelled documents that the model is fitted on, at most, in all and by language; taken by the hash of their id. All words
#: of their whole texts take part.
FIT_DOCS, FIT_DOCS_EACH = 4_000, 1_000
ROUNDS = 4
#: Added to the expected count of every piece.
SMOOTH = 0.02
#: Longest run of letters scored as one word; longer runs are scored in stretches of that many letters, so that sums over
#: their segmentations stay inside the range of doubles.
RUN = 64
#: Words whose segmentations are summed together while fitting.
FIT_STEP = 20_000
#: Words that one worker remembers with their scores. Beyond it the memory starts afresh.
MEMORY = 200_000
RESULT = "doc_id long, lang_pred string, score double, n_letters long"

_LETTERS = re.compile(r"[^\W\d_]+")


def pieces_of(path: str) -> list[str]:
    """The pieces of a SentencePiece model, without its control and byte pieces; ``▁`` marks a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; long runs in stretches."""
    runs = _LETTERS.findall((text or "").lower())
    if not "".join(runs).isalpha():  # numerals that aren't digits, or no run at all
        runs = [x for x in ("".join(filter(str.isalpha, run)) for run in runs) if x]
    if runs and max(map(len, runs)) > RUN:
        runs = [run[at : at + RUN] for run in runs for at in range(0, len(run), RUN)]
    return runs


@dataclass
class Model:
    """log-free piece probabilities: a row for each piece, a column for each language; the last row is an unknown character."""

    langs: list[str]
    pieces: dict[str, int]
    probs: np.ndarray
    prior: np.ndarray

    def __post_init__(self):
        self.memory: dict[str, int] = {}  # rows of the table of scored words
        self.table = np.zeros((0, len(self.langs)))
        self.automaton = None

    def __reduce__(self):
        return Model, (self.langs, self.pieces, self.probs, self.prior)

    def lattice(self, words: list[str]) -> Lattice:
        """The segmentations of some words."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for piece, i in self.pieces.items():
                self.automaton.add_word(piece, i << 16 | len(piece))
            self.automaton.make_automaton()
        text = "".join(f"▁{w}\n" for w in words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.cumsum(lengths + 1) - lengths - 1
        offset = np.arange(len(text)) - np.repeat(first, lengths + 1)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, width, piece = found[:, 0] + 1, found[:, 1] & 0xFFFF, found[:, 1] >> 16
        alone = np.ones(len(text), bool)
        alone[first + lengths] = False
        alone[end[width == 1] - 1] = False
        unknown = np.flatnonzero(alone)
        start = np.concatenate([end - width, unknown])
        end = np.concatenate([end, unknown + 1])
        piece = np.concatenate([piece, np.full(len(unknown), len(self.pieces))])
        order = np.argsort(offset[start], kind="stable")
        return Lattice(start[order], end[order], piece[order], offset, first, lengths)

    def scaled(self) -> np.ndarray:
        """The probabilities with a factor of ten a character, so that the sums of the longest word stay inside the range of
        doubles."""
        return self.probs * 10.0 ** np.array([*map(len, self.pieces), 1])[:, None]

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word for each language, summed over its segmentations, all words at once."""
        if not hasattr(self, "held"):
            self.held = self.scaled()
        x = self.lattice(words)
        return np.log(np.maximum(x.forward(self.held)[x.first + x.lengths], 1e-300)) - x.lengths[:, None] * math.log(10)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, its posterior, letters) of each whole text; ``und`` and 0 without a letter."""
        words = [words_of(x) for x in texts]
        if not self.langs:
            return [("und", 0.0, sum(map(len, x))) for x in words]
        new = {w for x in words for w in x if w not in self.memory}
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
            new = {w for x in words for w in x}
        if new:
            size = len(self.memory) + len(new)
            if len(self.table) < size:
                self.table = np.concatenate([self.table, np.zeros((size, len(self.langs)))])
            self.table[len(self.memory) : size] = self.words(list(new))
            self.memory.update(zip(new, range(len(self.memory), size), strict=True))
        return [self._best(x) if x else ("und", 0.0, 0) for x in words]

    def _best(self, words: list[str]) -> tuple[str, float, int]:
        weighed = self.prior + self.table[np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))].sum(0)
        weighed = np.exp(weighed - weighed.max())
        best = int(np.argmax(weighed))
        return self.langs[best], float(weighed[best] / weighed.sum()), sum(map(len, words))


@dataclass
class Lattice:
    """Edges (start, end, piece) of the segmentations of some words laid end to end, by rising distance of the start from its
    word's start; ``offset`` is that distance for every character, ``first`` and ``lengths`` are a word's place and size."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    lengths: np.ndarray

    def steps(self, order: np.ndarray) -> list[tuple[int, int]]:
        """The bounds of the edges of each distance, for the distances of all edges in rising order."""
        edges = np.searchsorted(order, np.arange(int(self.lengths.max()) + 2 if len(self.lengths) else 1)).tolist()
        return list(zip(edges, [*edges[1:], len(order)], strict=True))

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """For each place and language the sum over all ways from the word's start. Edges of one distance end apart."""
        sums = np.zeros((len(self.offset) + 1, probs.shape[1]))
        sums[self.first] = 1.0
        for a, b in self.steps(self.offset[self.start]):
            sums[self.end[a:b]] += sums[self.start[a:b]] * probs[self.piece[a:b]]
        return sums

    def backward(self, probs: np.ndarray) -> np.ndarray:
        """For each place and language the sum over all ways to the word's end."""
        sums = np.zeros((len(self.offset) + 1, probs.shape[1]))
        sums[self.first + self.lengths] = 1.0
        far = self.offset[self.end - 1] + 1
        order = np.argsort(far, kind="stable")
        start, end, piece = self.start[order], self.end[order], self.piece[order]
        for a, b in reversed(self.steps(far[order])):
            sums[start[a:b]] += sums[end[a:b]] * probs[piece[a:b]]
        return sums

    def expected(self, probs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected pieces by language, where word w occurs ``weights[w, language]`` times."""
        forward, backward = self.forward(probs), self.backward(probs)
        total = forward[self.first + self.lengths]
        share = np.divide(weights, total, out=np.zeros_like(weights), where=total > 0)
        word = np.searchsorted(self.first, self.start, side="right") - 1
        each = forward[self.start] * probs[self.piece] * backward[self.end] * share[word]
        return np.stack([np.bincount(self.piece, each[:, k], len(probs)) for k in range(probs.shape[1])], axis=1)


def fit_counts(counts: dict[str, Counter], docs: Counter, pieces: list[str]) -> Model:
    """The model of word counts by language, by expectation maximisation over all segmentations of all words. No labelled
    word gives a model without languages."""
    langs = sorted(counts)
    index = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
    total = max(sum(docs.values()), 1)
    prior = np.log(np.array([max(docs[x], 1) / total for x in langs] or [1.0]))
    width = np.array([len(p) for p in index] + [1], float)
    start = (0.03 ** width)[:, None] * np.ones((1, max(len(langs), 1)))
    model = Model(langs, index, start / start.sum(0), prior)
    words = sorted(set(chain.from_iterable(counts.values())))
    for _ in range(ROUNDS):
        expected, probs = np.zeros_like(model.probs), model.scaled()
        for at in range(0, len(words), FIT_STEP):
            some = words[at : at + FIT_STEP]
            weights = np.array([[counts[x][w] for x in langs] for w in some], float)
            expected += model.lattice(some).expected(probs, weights)
        # A piece that one language lacks keeps the share of all languages, so unseen pieces don't decide.
        shared = expected.sum(1, keepdims=True)
        expected = expected + SMOOTH + 0.001 * shared
        model.probs = expected / expected.sum(0)
    return Model(langs, index, model.probs, prior)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = {}
    for batch in slices(batches):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(words_of(text))
    rows = [(lang, word, n) for lang, c in found.items() for word, n in c.items()]
    for at in range(0, len(rows), 10_000):
        lang, word, n = zip(*rows[at : at + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(word), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def held_out() -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 5, is 0. A null id is as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, vocabulary: str | None = None) -> Model:
    """The model of the labelled documents of ``docs`` that aren't held out: a bounded sample by the hash of the id,
    at most ``FIT_DOCS_EACH`` of a language and ``FIT_DOCS`` in all."""
    labelled = docs.where("lang is not null and text is not null").where(~held_out())
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    if not sizes:
        return fit_counts({}, Counter(), [])
    share = min(FIT_DOCS_EACH, max(1, FIT_DOCS // len(sizes)))
    rates = docs.sparkSession.createDataFrame([(lang, min(1.0, share / n)) for lang, n in sizes], "lang string, rate double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    words = (
        labelled.join(F.broadcast(rates), "lang").where(place < F.col("rate")).select("text", "lang")
        .mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    counts: dict[str, Counter] = {lang: Counter() for lang, _ in sizes}
    for lang, word, n in zip(*words.toArrow().to_pydict().values(), strict=True):  # the words of at most FIT_DOCS documents
        counts[lang][word] = n
    return fit_counts(counts, Counter(dict(map(tuple, sizes))), pieces_of(vocabulary or tokenizer_path("piece_bpe_32k.model")))


def _predict(key: str, model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = worker_state(key, lambda: model.value)
        for batch in slices(batches):
            found = mine.texts(batch.column("text").to_pylist())
            lang, score, letters = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letters, pa.int64())], names=["doc_id", "lang_pred", "score", "n_letters"])

    return predict


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and n_letters of every row; a map over whole texts that reads nothing but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages: bounded by the vocabulary
    return docs.select("doc_id", "text").mapInArrow(_predict(uuid.uuid4().hex, shared), RESULT)


def language_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    A null text and a text without letters are ``und`` with score 0; a null lang is not learned from; a null doc_id is
    kept and learned from like any other; ties go to the first language by name; repeated rows give repeated results;
    without a labelled row every text is ``und``; other columns are ignored.
    """
    return predict(docs, fit(docs, vocabulary)).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "n_letters")


#: Posterior under which a text counts as of no known language.
SURE = 0.5


def _filter(key: str, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = worker_state(key, lambda: model.value)
        for batch in slices(batches):
            found = mine.texts(batch.column("text").to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= SURE for lang, score, _ in found], pa.bool_()))

    return run


def keep_known(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` without texts that have no letter or no language of a posterior of ``SURE``.

    A map: columns of any name and their order are kept. A null text goes; a null lang or doc_id is not looked at; equal rows
    stay or go together; without a labelled row every text goes; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, vocabulary))
    return docs.mapInArrow(_filter(uuid.uuid4().hex, shared), docs.schema)
