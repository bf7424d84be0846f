"""Simple-8b word-aligned coding of non-negative integers, vectorised both ways.

A 64-bit word holds a 4-bit selector and as many integers as its width allows. The integers are taken in blocks of ``BLOCK``; a
word never reaches over the end of a block, and the offset of each block's first word is kept, so that any block is decoded
alone. An integer of more than 60 bits is an escape: a selector without integers, then the integer in a word of its own.

Layout of a payload (little-endian): magic, number of integers, number of blocks, number of words (8 bytes each), the word
offset of each block (4 bytes each, padded to 8), the words.
"""

from __future__ import annotations

import numpy as np

MAGIC = int.from_bytes(b"S8BLOCK1", "little")
BLOCK = 256
#: Integers per word by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_BEYOND = 255


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each value (1 for zero)."""
    if not len(values) or values.max() < 1 << 52:
        return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)
    out = np.ones(len(values), np.uint8)
    rest = values.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        big = high > 0
        out[big] += step
        rest = np.where(big, high, rest)
    return out


def _choose(values: np.ndarray) -> np.ndarray:
    """Selector with which a word would start at each value: the first in order whose integers all fit before the block ends."""
    n_blocks = -(-len(values) // BLOCK)
    bits = np.full((n_blocks, BLOCK + 60), _BEYOND, np.uint8)
    flat = np.full(n_blocks * BLOCK, _BEYOND, np.uint8)
    flat[: len(values)] = _bits(values)
    bits[:, :BLOCK] = flat.reshape(n_blocks, BLOCK)
    chosen = np.zeros((n_blocks, BLOCK), np.uint8)
    run, reach, blocks = bits.copy(), 1, np.arange(n_blocks)
    for selector in range(len(COUNTS) - 1, 0, -1):  # from one integer a word to sixty
        while reach < COUNTS[selector]:
            np.maximum(run[:, :-reach], bits[:, reach:], out=run[:, :-reach])
            reach += 1
        fits = run[:, :BLOCK] <= WIDTHS[selector]
        some = fits.any(axis=1)
        if not some.all():  # a block that takes no word of this kind takes none that holds more
            bits, run, blocks, fits = bits[some], run[some], blocks[some], fits[some]
        part = chosen[blocks]
        part[fits] = selector
        chosen[blocks] = part
    return chosen.reshape(-1)[: len(values)]


def encode(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, np.uint64)
    n, n_blocks = len(values), -(-len(values) // BLOCK)
    chosen = _choose(values) if n else np.zeros(0, np.uint8)
    # all blocks are walked at once, a word of each per step
    at = np.arange(n_blocks, dtype=np.int64) * BLOCK
    stop = np.minimum(at + BLOCK, n)
    starts = []
    while len(at):
        starts.append(at)
        at = at + COUNTS[chosen[at]]
        keep = at < stop
        at, stop = at[keep], stop[keep]
    start = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    selector = chosen[start]
    places = np.where(selector == 0, 2, 1)
    place = np.cumsum(places) - places
    words = np.zeros(int(places.sum()), np.uint64)
    words[place] = selector.astype(np.uint64)
    for s in np.unique(selector):
        mine = selector == s
        if s == 0:
            words[place[mine] + 1] = values[start[mine]]
            continue
        for k in range(COUNTS[s]):
            words[place[mine]] |= values[start[mine] + k] << np.uint64(4 + k * WIDTHS[s])
    block_of = start // BLOCK
    offsets = place[np.searchsorted(block_of, np.arange(n_blocks), "left")].astype("<u4")
    pad = b"\0" * (-offsets.nbytes % 8)
    return np.array([MAGIC, n, n_blocks, len(words)], "<u8").tobytes() + offsets.tobytes() + pad + words.astype("<u8").tobytes()


def _parts(payload: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    magic, n, n_blocks, n_words = (int(x) for x in np.frombuffer(payload, "<u8", 4))
    if magic != MAGIC:
        raise ValueError("not a Simple-8b payload")
    offsets = np.frombuffer(payload, "<u4", n_blocks, 32)
    words = np.frombuffer(payload, "<u8", n_words, 32 + -(-n_blocks * 4 // 8) * 8)
    return n, offsets, words


def _unpack(words: np.ndarray, n: int) -> np.ndarray:
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words that follow an escape hold no selector
    if (selector == 0).any():
        for i in np.flatnonzero(selector == 0):
            if not raw[i]:
                raw[i + 1] = True
    head = np.flatnonzero(~raw)
    count = COUNTS[selector[head]]
    begin = np.cumsum(count) - count
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector[head]):
        mine = selector[head] == s
        at, into = head[mine], begin[mine]
        if s == 0:
            out[into] = words[at + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[into + k] = (words[at] >> np.uint64(4 + k * WIDTHS[s])) & mask
    return out


def decode(payload: bytes) -> np.ndarray:
    n, _, words = _parts(payload)
    return _unpack(words, n)


def decode_block(payload: bytes, block: int) -> np.ndarray:
    """The integers of one block, from its words alone."""
    n, offsets, words = _parts(payload)
    stop = offsets[block + 1] if block + 1 < len(offsets) else len(words)
    return _unpack(words[offsets[block] : stop], min(BLOCK, n - block * BLOCK))
