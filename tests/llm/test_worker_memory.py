import gc
import hashlib
import random
import tracemalloc
import weakref

import pyarrow as pa
from tokenizers import Tokenizer

from tessella.llm import bpe_codec
from tessella.llm.common import Memory, no_state, tokenizer_path, worker_state

PATH = tokenizer_path("word_bpe_49k.json")


class Looped:
    def __init__(self):
        self.memory = Memory(lambda x: self, 10)


def test_a_worker_lets_go_of_what_points_to_itself():
    gone = weakref.ref(worker_state("looped", Looped))
    gc.disable()
    try:
        no_state()
        assert gone() is None
    finally:
        gc.enable()


def test_a_remembered_word_is_small():
    rng, mine = random.Random(3), bpe_codec.PrefixBpe(PATH)
    text = " ".join("".join(rng.choice("abdeinorst") for _ in range(9)) for _ in range(20_000))
    mine.encode(" ".join(text.split(" ")[:50]))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        mine.encode_all([text])
        gc.collect()
        mine.fits.clear()
        assert (tracemalloc.get_traced_memory()[0] - before) / 20_000 < 240
    finally:
        tracemalloc.stop()


def test_codes_and_digest_equal_the_library():
    library = Tokenizer.from_file(PATH)
    special = next(iter(library.get_added_tokens_decoder().values())).content
    texts = ["The cat's 12 hats, é日\n\tend", None, "", f"a {special} b{special}", special, "  ", "Word " * 3_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    codes = [r for x in bpe_codec._codes(PATH)([batch]) for r in x.to_pylist()]
    digests = [r for x in bpe_codec._digest(PATH)([batch]) for r in x.to_pylist()]
    for text, code, digest in zip(texts, codes, digests, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (code["ids"], code["decoded"]) == (ids, decoded)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        assert (digest["n_tokens"], digest["ids_sha256"], digest["decoded_sha256"]) == (len(ids), *sha)
