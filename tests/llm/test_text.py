import random
import re

import numpy as np
import pyarrow as pa

from loomlog.llm import text as T

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DARK = re.compile("[^\x20\x09-\x0d]+")


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_words_equal_the_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ09 .é日-\n\x00\x7f `{") for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", "x" * 600_000]
    for pattern, classes in ((WORD, T.WORD), (DARK, T.DARK)):
        folded, starts, ends, rows, hashes = T.words(*T.column(pa.array(texts)), classes)
        got = [[] for _ in texts]
        for a, b, r in zip(starts, ends, rows):
            got[r].append(folded[a:b].tobytes().decode())
        assert got == [pattern.findall(fold(x or "")) for x in texts]
        by_word = {}
        for a, b, h in zip(starts, ends, hashes):
            assert by_word.setdefault(folded[a:b].tobytes(), h) == h
        assert len(set(by_word.values())) == len(by_word)


def test_column_of_a_slice():
    array = pa.array(["ab", None, "", "cde", "f"]).slice(1, 3)
    data, offsets = T.column(array)
    assert data.tobytes() == b"cde" and offsets.tolist() == [0, 0, 0, 3]


def test_portions_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 100, 1, 1, 1)])], names=["text"])
    parts = list(T.portions(batch, "text", 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 2


def test_ragged():
    assert T.ragged(np.array([3, 10, 0]), np.array([2, 0, 3])).tolist() == [3, 4, 0, 1, 2]
