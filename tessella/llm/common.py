"""Small helpers that the operators for training data share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import accumulate
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a record batch that are turned into Python objects at a time.
STEP = 256
#: Bytes of a text column that are taken at a time where texts are handled together.
STEP_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``step`` rows, so that Python objects of few rows live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of a text column, a longer row by itself."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Memory(dict):
    """What ``make`` gives for a key, remembered. The entries live in two generations: when the younger is full it becomes
    the elder, and an entry that is asked for moves to the younger, so what is in use stays and memory is bounded."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.elder = make, size, {}

    def __missing__(self, key):
        if (found := self.elder.get(key)) is None:
            found = self.make(key)
        if len(self) >= self.size:
            self.elder = dict(self)
            self.clear()
        self[key] = found
        return found


def parted(texts: list[str], white: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct pieces between spaces (``white``: runs of ASCII white space) of some texts, the place of each piece
    among them, and where a text's pieces start (one more entry than texts). An empty text is one empty piece."""
    column = pa.array(texts, pa.large_string())
    lists = pc.ascii_split_whitespace(column) if white else pc.split_pattern(column, " ")
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), lists.offsets.to_numpy()


def listed(column: pa.Array) -> list:
    """A column of strings without nulls as a list, many times faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as Python strings; null is the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def prefix_sums(values: list[int]) -> list[int]:
    """For each value the sum of those before it."""
    return [0, *accumulate(values)][:-1]


def tokenizer_path(name: str) -> str:
    """Where the file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


T = TypeVar("T")
_STATE: dict[str, object] = {}


def worker_state(key: str, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task (a codec, a model, what they remember). Only the latest is kept, so workers
    that serve one operator after another don't gather the memories of all."""
    if key not in _STATE:
        if _STATE:
            _STATE.clear()
            _give_back()
        _STATE[key] = make()
    return _STATE[key]


def _give_back() -> None:
    """Hand memory that is free back to the system. A codec or a model points to itself through what it remembers, so it
    only goes when cycles are collected, and the allocator keeps its pages until it is asked."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def no_state() -> None:
    """Let go of what the worker keeps: for operators that keep nothing."""
    worker_state("", lambda: None)
