from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark

from tessella.llm import lbl_lm


def test_every_position_is_trained_on(monkeypatch):
    texts = ["a b c d e f g h i j", "b a", "", None, "c " * 40]
    shared = np.zeros(lbl_lm.SHARED, np.int64)
    model = lbl_lm.Model(["a", "b", "\n"], np.array([2, 2, 5]), shared, shared, None, 57, 12)
    model.params = lbl_lm.first_params(model.class_counts())
    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    out = next(iter(lbl_lm._train("test", SimpleNamespace(value=model))([batch])))
    assert out.column("seen")[0].as_py() == sum(len(lbl_lm.words_of(x)) for x in texts)
