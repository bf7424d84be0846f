"""Pieces of one hash are told apart by all their bytes; small and large integers choose their words block by block."""

import numpy as np

from loomlog.llm import simple8b
from loomlog.llm import token_files as tf


def same(a: bytes, b: bytes) -> bool:
    data = np.frombuffer(a + b, np.uint8)
    return tf._same_bytes(data, np.array([0, len(a)]), np.array([len(a), len(b)]), np.array([0, 0]))


def test_each_byte_counts():
    for n in (1, 7, 8, 9, 16, 17, 40):
        text = bytes(range(65, 65 + n))
        assert same(text, text)
        for at in {0, n - 1, n // 2}:
            assert not same(text, text[:at] + b"!" + text[at + 1 :])
    assert not same(b"ab", b"abc")


def test_blocks_of_all_kinds():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 1 << int(w), simple8b.BLOCK * 2 + 3, np.uint64) for w in (1, 2, 3, 5, 8, 16, 30, 60, 62)]
    values = np.concatenate([*parts, np.zeros(700, np.uint64)])
    coded = simple8b.encode(values)
    assert np.array_equal(simple8b.decode(coded), values)
    assert all(np.array_equal(simple8b.decode_block(coded, i), values[i * simple8b.BLOCK : (i + 1) * simple8b.BLOCK]) for i in range(-(-len(values) // simple8b.BLOCK)))
    assert len(simple8b.encode(np.zeros(240, np.uint64))) == 32 + 8 + 4 * 8  # sixty to a word
