"""Simple-8b word-aligned coding of unsigned ids in numpy.

A 64-bit word holds a selector in its top four bits. Selectors 1 to 14 pack ``COUNTS[s]`` ids of ``BITS[s]`` bits each,
lowest bits first. Selector 0 is the escape: its payload is an index into the block's list of exceptions, which hold ids
of more than 60 bits. The last word of a block may be padded with zeros; the block's number of ids cuts them off.
"""

from __future__ import annotations

import numpy as np

#: Ids per word and bits per id, by selector. Fixed values of the format.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


#: Words that are walked over at a time, as a power of two.
LEAPS = 3

_SHORT = np.frexp(np.arange(1 << 16))[1].astype(np.int8)


def _widths(ids: np.ndarray) -> np.ndarray:
    if ids.max() < len(_SHORT):
        return _SHORT[ids.astype(np.uint16)]
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.int8)


def _starts(taken: np.ndarray) -> np.ndarray:
    """The places from 0 on where each is ``taken`` of the one before further, up to the end. Only one in 2 ** LEAPS is
    walked; those between follow by leaps of 2 ** k words, which are tabled for all places."""
    n = len(taken)
    leaps = [np.append(np.minimum(np.arange(n, dtype=np.int32) + taken, n), np.int32(n))]
    for _ in range(LEAPS):
        leaps.append(leaps[-1][leaps[-1]])
    far, found, at = memoryview(leaps.pop()), [], 0
    while at < n:
        found.append(at)
        at = far[at]
    starts = np.array(found, np.int32)
    for leap in leaps[::-1]:
        starts = np.stack([starts, leap[starts]], axis=1).ravel()
    return starts[starts < n]


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, exceptions), both of unsigned 64-bit integers. No ids give no words."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    ids = np.concatenate([ids.astype(np.uint64), np.zeros(60, np.uint64)])
    widths = _widths(ids)
    best = np.where(widths[:n] > 60, 0, 14).astype(np.int8)
    widest = {1: widths}  # by window: the widest id of the window that starts at each place
    for s in range(13, 0, -1):
        c = int(COUNTS[s])
        half = max(k for k in widest if k < c)
        # two windows that overlap or touch cover the longer one
        widest[c] = np.maximum(widest[half][: n + 60 - c], widest[half][c - half :][: n + 60 - c])
        np.copyto(best, np.int8(s), where=widest[c][:n] <= np.int8(BITS[s]))
    starts = _starts(COUNTS.astype(np.int32)[best])
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = chosen == s
        if s == 0:
            words[mine] |= np.arange(mine.sum(), dtype=np.uint64)
            continue
        at, word = starts[mine], words[mine]
        for slot in range(COUNTS[s]):
            word |= ids[at + slot] << np.uint64(slot * BITS[s])
        words[mine] = word
    return words, ids[starts[chosen == 0]]


def unpack(words: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen):
        mine = chosen == s
        if s == 0:
            out[at[mine]] = exceptions[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        slots = np.arange(COUNTS[s])
        out[at[mine][:, None] + slots] = (words[mine][:, None] >> (slots * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
    return out[:n]
