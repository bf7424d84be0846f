"""Whole Arrow columns of text as byte arrays: words, word hashes and spans without a Python string per word.

All arrays of a batch are cut into slices of some hundred thousand bytes before anything wider than a
byte is made of them, so memory follows the slice and not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

# Byte classes. Folding touches A-Z only; bytes from 0x80 on belong to words of either kind.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
WORD = np.ones(256, dtype=bool)  # after folding: digits, a-z and everything beyond ASCII
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
DARK = np.ones(256, dtype=bool)  # all but blank and the controls 9 to 13
DARK[[0x20, *range(0x09, 0x0E)]] = False


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string or binary column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A finisher that spreads every input bit over the 64 of the result."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, as long as asked for so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * SLICE)
            inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
            cls.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, MULTIPLIER, np.uint64))])
            cls.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, inverse, np.uint64))])
        return cls.up, cls.down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span. Spans ascend and do not overlap; they are hashed slice by slice from prefix sums."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        n = int(ends[j - 1] - base)
        up, down = _Powers.of(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the runs of True; runs stop where rows do."""
    if not len(member):
        z = np.zeros(0, np.int64)
        return z, z, z
    before, after = np.empty_like(member), np.empty_like(member)
    before[0], before[1:] = False, member[:-1]
    after[-1], after[:-1] = False, member[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts, ends = np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes; start, end, row and hash of each word."""
    folded = FOLD[data]
    starts, ends, rows = spans(classes[folded], offsets)
    return folded, starts, ends, rows, span_hashes(folded, starts, ends)


def portions(batch: pa.RecordBatch, name: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` bytes of text, or of one row."""
    _, off = column(batch.column(name))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield batch.slice(i, j - i)
        i = j
    pa.default_memory_pool().release_unused()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i] ... starts[i] + counts[i] - 1, one run after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    heads = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - heads, counts)
