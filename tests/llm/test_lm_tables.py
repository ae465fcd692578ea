import tracemalloc

import numpy as np

from tessella.llm import lbl_lm


def test_a_text_is_classed_without_a_copy_of_the_table():
    n = 200_000
    shared = np.zeros(lbl_lm.SHARED, np.int64)
    model = lbl_lm.Model([f"w{k}" for k in range(n)], np.arange(n, 0, -1), shared, shared, None, n, n).open()
    words = ["w0", "w1700", "outside", "w199999", "w3"]
    ids = model.ids(words)
    model.classes_of(words, ids)
    tracemalloc.start()
    try:
        found = model.classes_of(words, ids)
        assert tracemalloc.get_traced_memory()[1] < 100_000
    finally:
        tracemalloc.stop()
    own = model.own
    assert found.tolist() == [0, *(own + lbl_lm.shared_class(x) for x in words[1:4]), 3]


def test_equal_rows_are_grouped():
    for n in (5, 1_000, 70_000):
        rows = np.random.default_rng(n).integers(0, n, 300)
        order, first, found = lbl_lm.Trainer._groups(rows, n)
        want, at = np.unique(rows, return_index=True)
        assert found.tolist() == want.tolist() and order[first].tolist() == at.tolist()
