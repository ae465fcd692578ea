"""Token-ID output: documents encoded by a public tokenizer and written as Simple-8b blocks.

The file format is Parquet of blocks. A block row carries ``part`` and ``block`` (its place in the order of the corpus),
``part_start`` (ids of the part before the block), the doc_ids and lengths of its documents, the number of ids, the coded
words and the exceptions. A block holds whole documents and closes at ``BLOCK_IDS`` ids; a longer document is a block by
itself. Blocks decode on their own, so a reader needs no neighbour.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import shared_dir, shuffle_width
from .bpe_codec import byte_symbols
from .common import Memory, byte_slices, listed, parted, slices, strings, tokenizer_path, worker_state
from .simple8b import pack, unpack

BLOCK_IDS = 32_768
#: Texts cut at spaces that one worker remembers with their ids, by generation.
MEMORY = 500_000

BLOCKS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("n_ids", T.LongType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("exceptions", T.BinaryType()),
    ]
)
ROWS = "part int, doc_id long, part_start long, n_tokens long, ids_crc32 long"

_RAGGED_SPACE = re.compile(r" (?=\s|\Z)")
_SPACE = re.compile(r" (?=\S)")
#: How byte-level tokenizers of this family part a text, for texts of nothing but these letters, ASCII
#: digits, visible ASCII marks, space and line feed. Other texts are parted by the library.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_PLAIN = re.compile(rf"[\n\x20-\x7e{_LETTERS}]*+")
_LETTERS_ONLY = re.compile(rf"[{_LETTERS}]++")
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n0-9{_LETTERS}]+|[ \n]+(?![^ \n])|[ \n]+")


#: Marks that stay one word of their own after letters.
_MARKS = ".,;:!?|*$%&#"


class PieceEncoder:
    """Ids of whole texts from the tokenizers library, which is asked once for each word.

    A byte-level tokenizer of this family never joins across a space that precedes a character other than white space,
    so the ids of a text are the ids of its pieces between spaces, joined. A piece of plain characters is parted into the
    tokenizer's words here and the library's model is asked for each word; other pieces go through the whole library, as
    do texts that hold a special token.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = self.library.model
        model._resize_cache(0)  # words are remembered here, so the library need not
        self.library.model = model
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.symbols = dict(enumerate(byte_symbols()))
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        steps = data["pre_tokenizer"] or {}
        #: Only a tokenizer that does nothing but byte-level parting is taken apart here.
        self.plain = data["normalizer"] is None and steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True)
        self.first, self.later = Memory(lambda x: self._learn(x, ""), memory), Memory(lambda x: self._learn(x, " "), memory)

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", [x.id for x in self.tokenize(word.encode().decode("latin-1").translate(self.symbols))]).tobytes()

    def _learn(self, piece: str, space: str) -> bytes:
        """The ids of a piece. Its words are remembered too, those that begin with the piece's space among the later ones."""
        if self.plain and piece.isalpha() and piece.isascii():  # most are
            return array("I", [x.id for x in self.tokenize((self.symbols[32] if space else "") + piece)]).tobytes()
        if not self.plain or not (piece.isascii() and piece.isprintable() or _PLAIN.fullmatch(piece)):
            return self._whole(space + piece)
        if piece.isalpha() and _LETTERS_ONLY.fullmatch(piece):
            return self._word(space + piece)
        words = _WORDS.findall(space + piece)
        if len(words) < 2:
            return self._word(words[0]) if words else b""
        first = self.first
        head = self.later[words[0][1:]] if space and len(words[0]) > 1 else self._word(words[0])
        return head + b"".join([first[x] if x[0] != " " else self._word(x) for x in words[1:]])

    def encode(self, text: str) -> np.ndarray:
        """Ids of one whole text."""
        if self.special.search(text):
            return np.frombuffer(self._whole(text), "<u4")
        head, *rest = _SPACE.split(text)
        return np.frombuffer(self.first[head] + b"".join(map(self.later.__getitem__, rest)), "<u4")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some whole texts; each distinct piece of theirs is looked up once."""
        odd = [bool(self.special.search(x) or _RAGGED_SPACE.search(x)) for x in texts]
        pieces, places, starts = parted([x for x, o in zip(texts, odd, strict=True) if not o])
        heads = starts[:-1]  # the first piece of a text follows no space
        keys, marked = pieces, np.zeros(0, np.int64)
        if self.plain:  # marks after a letter or digit are a word of their own, so the parts of such a piece are remembered
            stems = pc.utf8_rtrim(pieces, _MARKS)
            parts = pc.and_(pc.not_equal(pc.binary_length(pieces), pc.binary_length(stems)), pc.match_substring_regex(stems, rf"[0-9{_LETTERS}]\z"))
            keys, marked = pc.if_else(parts, stems, pieces), np.flatnonzero(parts.to_numpy(zero_copy_only=False))
        keys, first = listed(keys), self.first
        found = [*map(self.later.__getitem__, keys), *map(first.__getitem__, listed(pieces.take(pa.array(places[heads]))))]
        for k, whole in zip(marked.tolist(), listed(pieces.take(pa.array(marked))), strict=True):
            found[k] += first[whole[len(keys[k]) :]]
        places = places.copy()
        places[heads] = len(pieces) + np.arange(len(heads))
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        at = np.cumsum(sizes, dtype=np.int32) - sizes
        n = sizes[places]
        ends = np.cumsum(n, dtype=np.int64)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(at[places] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        plain = iter(np.split(ids, ends[starts[1:-1] - 1])) if len(heads) else iter(())
        return [self.encode(x) if o else next(plain) for x, o in zip(texts, odd, strict=True)]


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker and tokenizer."""
    return worker_state(f"pieces {path}", lambda: PieceEncoder(path))


def _write_blocks(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size, coder = 0, encoder(path)

        def close() -> pa.RecordBatch:
            nonlocal block, start, size
            ids = np.concatenate(held)
            words, exceptions = pack(ids)
            row = {
                "part": part, "block": block, "part_start": start, "doc_ids": docs[:], "lengths": [len(x) for x in held],
                "n_ids": len(ids), "words": words.astype("<u8").tobytes(), "exceptions": exceptions.astype("<u8").tobytes(),
            }
            block, start, size = block + 1, start + len(ids), 0
            docs.clear()
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_arrow_blocks())

        for batch in byte_slices(batches, "text"):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), coder.encode_all(strings(batch, "text")), strict=True):
                ids = np.append(found, np.uint32(end_id))
                if held and size + len(ids) > BLOCK_IDS:
                    yield close()
                docs.append(doc_id)
                held.append(ids)
                size += len(ids)
        if held:
            yield close()

    return write


def _arrow_blocks() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()), ("doc_ids", longs), ("lengths", longs), ("n_ids", pa.int64()), ("words", pa.binary()), ("exceptions", pa.binary())])


def decode_block(row: dict) -> list[np.ndarray]:
    """The ids of each document of a block."""
    ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["exceptions"], "<u8"), row["n_ids"]).astype("<u4")
    return np.split(ids, np.cumsum(row["lengths"])[:-1])


def _read_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 16):
        out: dict[str, list] = {"part": [], "doc_id": [], "part_start": [], "n_tokens": [], "ids_crc32": []}
        for row in batch.to_pylist():
            start = row["part_start"]
            for doc_id, ids in zip(row["doc_ids"], decode_block(row), strict=True):
                for k, v in zip(out, (row["part"], doc_id, start, len(ids), zlib.crc32(ids.tobytes())), strict=True):
                    out[k].append(v)
                start += len(ids)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))


def write_token_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, partitions: int | None = None) -> str:
    """Encode ``docs`` (doc_id, text) with the tokenizer file and write blocks to ``out`` in ascending doc_id order.

    One shuffle: whole texts go to ranges of doc_id and are sorted there; nothing is encoded twice. A null text is empty
    and still ends with ``end_id``; null doc_ids come first; rows that share a doc_id are ordered by their text's hash; an empty
    table writes no blocks; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    tie = F.xxhash64("text")  # the sampled range keys stay small
    ordered = rows.repartitionByRange(partitions or shuffle_width(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.select("doc_id", "text").mapInArrow(_write_blocks(tokenizer, end_id), BLOCKS).write.parquet(out)
    return out


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the files at ``path``."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each part written
    starts, before = [], 0
    for part, n in totals:
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "part int, offset long")
    rows = blocks.mapInArrow(_read_blocks, ROWS)
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("offset") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str | None = None, label: str = "token-ids") -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and return the digest that reading them back gives."""
    import uuid

    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tessella/{label}-{uuid.uuid4().hex}"
    return read_token_ids(spark, write_token_ids(docs, out, tokenizer or tokenizer_path("byte_bpe_50k.json")))
