import sys

import numpy as np
import pytest

from tessella.llm import simple8b


def walked(taken):
    found, at = [], 0
    while at < len(taken):
        found.append(at)
        at += int(taken[at])
    return found


@pytest.mark.parametrize("n", [1, 2, 7, 8, 59, 60, 61, 500])
def test_starts_of_words_equal_a_walk(n):
    rng = np.random.default_rng(n)
    for high in (2, 5, 61):
        taken = rng.integers(1, high, n).astype(np.int32)
        assert simple8b._starts(taken).tolist() == walked(taken)


def test_a_block_packs_without_a_step_a_word():
    """Ids of 16 bits stand three to a word. The interpreter's steps are counted: one for each word was most of the time."""
    ids, lines = np.full(32_768, 40_000, np.uint32), 0

    def count(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return count

    simple8b.pack(ids)  # what numpy loads at first use does not count
    sys.settrace(count)
    try:
        words, exceptions = simple8b.pack(ids)
    finally:
        sys.settrace(None)
    assert lines < len(words) and simple8b.unpack(words, exceptions, len(ids)).tolist() == ids.tolist()
