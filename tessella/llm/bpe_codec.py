"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word there is exactly one token that can end its encoding. It is found among the tokens that are
suffixes of the prefix (an Aho-Corasick automaton, which is the suffix automaton of a token set, reports them) as the one
that is compatible with the last token of the prefix before it: two tokens are compatible if the merge rules, applied to
their symbols side by side, leave exactly the two. The last tokens are stored for every prefix and followed back from the
end of the word.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Memory, byte_slices, listed, parted, ragged, strings, tokenizer_path, worker_state

#: Words, and pieces between spaces that aren't one word, that one worker remembers, by generation.
MEMORY = 160_000
#: Spines of tokens that one worker remembers for each side, by generation.
SPINES = 20_000
#: Stands for the mark of a word's end inside the automaton; no byte maps to it.
_END = "\n"
#: The words of a piece, as the tokenizer's own pattern has them, for pieces of nothing but these characters.
_LATIN = re.compile(r"[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff\u0152\u0153]+")
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff\u0153]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\u0153]+")
_SPACES = re.compile(r"[ \t\n\v\f\r]+")

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PrefixBpe:
    """The merges of a tokenizers-library BPE file as last-token tables."""

    def __init__(self, path: str, memory: int = MEMORY):
        import ahocorasick
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)  # its normalizer and pre-tokenizer part texts into words; its model isn't kept
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ends = bool(suffix)
        self.symbols = dict(enumerate(byte_symbols()))
        self.pairs: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.pairs[a, b] = rank
            self.made.setdefault(c, (rank, a, b))
        # Spines: how the outermost part of a token grows, as (part, rank of the merge that takes it into the next).
        # Those of the tokens that meet are remembered.
        self.right = Memory(lambda x: self._spine(x, 2), SPINES)
        self.left = Memory(lambda x: self._spine(x, 1), SPINES)
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            ended = self.ends and token.endswith(suffix) and len(token) > len(suffix)
            text = token.removesuffix(suffix) + _END if ended else token
            if i in self.made or len(text) - ended == 1:
                self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.memory = memory
        self.words = Memory(lambda x: array("I", self.encode_word(x)).tobytes(), memory)
        self.pieces = Memory(self._piece, memory)
        every = range(max(self.names, default=-1) + 1)
        #: By id: its decimal digits and the token's name.
        self.digits = pa.array(map(str, every), pa.large_string())
        self.tokens = pa.array(map(self.names.get, every), pa.large_string())

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        out, taken = [(token, float("inf"))], self.made.get(token)
        while taken:
            out.append((taken[side], taken[0]))
            taken = self.made.get(taken[side])
        return out[::-1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b apart.

        The two parts that meet at the border change as merges take them inward. A merge across the border happens if it
        comes before the one that takes its left part (merges of equal rank go from the left, so a tie is lost there) and
        not after the one that takes its right part.
        """
        key = a << 20 | b
        if (found := self.fits.get(key)) is not None:
            return found
        xs, ys, i, j, apart = self.right[a], self.left[b], 0, 0, True
        while True:
            (x, x_end), (y, y_end) = xs[i], ys[j]
            rank = self.pairs.get((x, y))
            if rank is not None and rank < x_end and rank <= y_end:
                apart = False
                break
            if x_end == y_end == float("inf"):
                break
            if x_end <= y_end:
                i += 1
            else:
                j += 1
        if len(self.fits) > 4 * self.memory:
            self.fits.clear()
        self.fits[key] = apart
        return apart

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-tokenized word, in the characters that stand for its bytes. ValueError if the vocabulary lacks one
        of them, which can't happen where it has all bytes."""
        n = len(word)
        if not n:
            return []
        text = word + _END if self.ends else word
        total, fits = len(text), self.fits
        last, back = [-1] * (total + 1), [0] * (total + 1)
        for end, (width, token) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0 or (self.ends and end == n):
                continue
            start = end - width
            if start:
                if (before := last[start]) < 0:
                    continue
                if (fit := fits.get(before << 20 | token)) is None:
                    fit = self.compatible(before, token)
                if not fit:
                    continue
            last[end], back[end] = token, start
        if last[total] < 0:
            raise ValueError(f"no encoding for {word!r}")
        out, at = [], total
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece without ASCII white space: its words, one after another."""
        if piece.isascii() and piece.isprintable():
            found = _LATIN_WORDS.findall(piece.lower())
        elif _LATIN.fullmatch(piece):
            found = [x.encode().decode("latin-1").translate(self.symbols) for x in _LATIN_WORDS.findall(piece.lower())]
        else:
            found = [x for x, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(piece))]
        return self.words[found[0]] if len(found) == 1 else b"".join([self.words[x] for x in found])

    def _entry(self, piece: str) -> bytes:
        if piece.isascii():
            low = piece.lower()
            if low.isalpha():
                return self.words[low]
            stem = low.rstrip(".,;:!?|*$%&#")
            if stem.isalpha():
                return self.words[stem] + self.words[low[len(stem) :]]
        return self.pieces[piece]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some whole texts, one after another, and where a text's ids start (one more entry than texts)."""
        odd = {k: x for k, x in enumerate(texts) if self.split is not None and self.split.search(x)}
        pieces, places, starts = parted(["" if k in odd else x for k, x in enumerate(texts)], white=True)
        entries = [self._entry(x) for x in listed(pieces)]
        places = places.copy()
        for k, x in odd.items():  # a text with special tokens is a piece of its own
            places[starts[k]] = len(entries)
            entries.append(b"".join([array("I", [self.special[y]]).tobytes() if y in self.special else self._spaced(y) for y in self.split.split(x)]))
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        n = sizes[places]
        ids = np.frombuffer(b"".join(entries), "<u4")[np.repeat((np.cumsum(sizes) - sizes)[places], n) + ragged(n)]
        return ids, np.append(0, np.cumsum(n))[starts]

    def _spaced(self, text: str) -> bytes:
        return b"".join([self._entry(x) for x in _SPACES.split(text)])

    def encode(self, text: str) -> list[str]:
        """Ids of a whole text in decimal."""
        return [*map(str, self.encode_all([text])[0].tolist())]

    def decode(self, ids: list[str]) -> str:
        """The tokens' names joined by a space, as for a file without a decoder."""
        return " ".join([self.names[int(i)] for i in ids])


def codec(path: str) -> PrefixBpe:
    """One codec a worker and tokenizer."""
    return worker_state(f"bpe {path}", lambda: PrefixBpe(path))


def _spelt(names: pa.Array, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """For each text the names of its ids, joined by a space."""
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), names.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


def _digest(path: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sha = codec(path), hashlib.sha256
        for batch in byte_slices(batches, "text"):
            ids, starts = coder.encode_all(strings(batch, "text"))
            hashes = [pa.array([sha(x).hexdigest() for x in _spelt(names, ids, starts).cast(pa.large_binary()).to_pylist()], pa.string()) for names in (coder.digits, coder.tokens)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts), pa.int64()), *hashes], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def _codes(path: str):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in byte_slices(batches, "text"):
            ids, starts = coder.encode_all(strings(batch, "text"))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view("<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), lists, _spelt(coder.tokens, ids, starts).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return codes


def bpe_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text of ``docs``.

    A map over whole texts: no shuffle, and a lost task is run again by itself. A null or empty text has no tokens and
    the hashes of the empty string; a null doc_id is kept; repeated rows give repeated results; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_digest(tokenizer or tokenizer_path("word_bpe_49k.json")), DIGEST)


def bpe_codes(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, the ids of its whole text and the text that they decode to; nulls as in :func:`bpe_digest`."""
    return docs.select("doc_id", "text").mapInArrow(_codes(tokenizer or tokenizer_path("word_bpe_49k.json")), "doc_id long, ids array<int>, decoded string")
