"""The common words of BPE, packed without an object for each."""

import tracemalloc

import numpy as np
import pyarrow as pa

from evidra.llm import bpe


def test_packed_words_take_no_objects():
    words = [f" word{n}\u00e9" for n in range(50_000)]
    rows = pa.table({"w": pa.chunked_array([words[:1000], [], words[1000:]], pa.string()), "ids": pa.chunked_array([["1 2 65534"] * 1000, [], ["7"] * 49_000], pa.string())})
    tracemalloc.start()
    joined, ids, lengths = bpe.packed_words(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert joined.decode().split("\0") == words and ids.dtype == np.uint16
    assert ids[:3].tolist() == [1, 2, 65534] and lengths.tolist() == [3] * 1000 + [1] * 49_000 and len(ids) == 52_000
    assert peak < 60 * len(words)


def test_packed_words_of_none():
    joined, ids, lengths = bpe.packed_words(pa.table({"w": pa.array([], pa.string()), "ids": pa.array([], pa.string())}))
    assert (joined, len(ids), len(lengths)) == (b"", 0, 0)
