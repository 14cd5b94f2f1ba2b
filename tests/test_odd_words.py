"""Every text with a word has a direction, whatever its words' signs and its white space."""

import itertools

import numpy as np
import pyarrow as pa

from lodegauge.functions.text import small
from lodegauge.operators import retrieval


def test_words_that_cancel_and_odd_spaces():
    encode = retrieval.hashed_encoder()
    one = {w: encode([w])[0] for w in (f"w{i}" for i in range(2000))}
    a, b = next((a, b) for a, b in itertools.combinations(one, 2) if not (one[a] + one[b]).any())
    texts = [f"{a} {b}", f"{b} {a} {a} {b}", " ", "\x1c", " \t\n\x0b\x0c\r ", "", None]
    norms = np.linalg.norm(encode(texts), axis=1)
    assert np.allclose(norms, [1, 1, 1, 1, 0, 0, 0])
    assert np.array_equal(encode([f"{a} x X"]), encode([f"x {a.upper()} x"]))


def test_batches_are_cut_by_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 100)], names=["text"])
    parts = list(small([b], 10_000))
    assert sum(p.num_rows for p in parts) == 100 and max(p.num_rows for p in parts) <= 10
    assert [p.num_rows for p in small([b.slice(0, 1)], 10)] == [1] and list(small([b.slice(0, 0)])) == []
