"""Packing of token sequences by bounded-space online best-fit (operator 11).

A task takes its documents as they come, encodes them and puts each piece into the open bin that it leaves fullest. Open bins are found by a
bitset over free space: bit f is set while a bin with f free tokens is open, so the best fit is the lowest set bit
from the length on. At most ``OPEN`` bins are open; when one more is needed, the fullest closes. A bin without free space closes at once.

Bins that are still open when a task ends are taken apart, and their pieces (no texts, some 60 bytes each) are packed again by fewer tasks
in the same way, the longest first, so that short tasks leave few half-empty bins behind. The first result is written once; a lost executor repeats tasks with the same rows in the same order and the same numbers.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import documents as docs
from loomlog.llm import text as T
from loomlog.plans.stage import staged

LENGTH = 2048
OPEN = 2048
END = 0
REMEMBERED = 500_000
AGAIN_ROWS = 200_000  # left-over pieces that a task packs again
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
_TASK = 1 << 32  # sequences of one task
_AGAIN = 1 << 62  # what the second round numbers is above this

_BLANKS = b" \t\n\x0b\x0c\r"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = ~T.WORD & T.DARK  # after folding: visible ASCII that is neither letter nor digit, and controls
_SIGN[65:91] = False


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of words from the tokenizers library; special tokens' strings are ordinary text. Words not met for ``REMEMBERED`` others are forgotten."""

    _own: dict[str, Words] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Words:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words, 4 bytes each."""
        young, old = self.young, self.old
        new = []
        for word in words:
            if word not in young:
                if word in old:
                    young[word] = old[word]
                else:
                    new.append(word)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            young.update(zip(part, self._encode([w.decode() for w in part]), strict=True))
        out = [young[w] for w in words]
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return out

    def _encode(self, words: list[str], many: int = 64) -> list[bytes]:
        """Words of letters alone are encoded side by side, as each of them should end in the only token that ends a word; where a chunk has more such tokens, its words go one by one."""
        out: list[bytes] = [b""] * len(words)
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        single = [i for i, w in enumerate(words) if not w.isalpha()]
        chunks = [letters[i : i + many] for i in range(0, len(letters), many)]
        coded = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in chunk]) for chunk in chunks], add_special_tokens=False)
        for chunk, encoding in zip(chunks, coded, strict=True):
            ids = np.array(encoding.ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(chunk) or ends[-1] != len(ids):
                single += chunk
                continue
            raw, a = ids.tobytes(), 0
            for i, b in zip(chunk, (4 * ends).tolist(), strict=True):
                out[i], a = raw[a:b], b
        for i, encoding in zip(single, self.tokenizer.encode_batch_fast([words[i] for i in single], add_special_tokens=False), strict=True):
            out[i] = array("I", encoding.ids).tobytes()
        return out


class OpenBins:
    """Best-fit over at most ``most`` open bins of ``size``; bins are numbered from ``first`` as they are opened."""

    def __init__(self, size: int = LENGTH, most: int = OPEN, first: int = 0):
        self.size, self.most, self.next = size, most, first
        self.free = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.n_open = 0

    def put(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece of 1 to ``size`` tokens."""
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            where = self._take(room)
        else:
            if self.n_open == self.most and length < self.size:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            where, room = self.next, self.size
            self.next += 1
        if room > length:
            self.by_free.setdefault(room - length, []).append(where)
            self.free |= 1 << (room - length)
            self.n_open += 1
        return where, self.size - room

    def _take(self, room: int) -> int:
        bins = self.by_free[room]
        where = bins.pop()
        if not bins:
            self.free &= ~(1 << room)
        self.n_open -= 1
        return where

    def open(self) -> set[int]:
        return set(chain.from_iterable(self.by_free.values()))


def pack(lengths: Iterable[int], size: int = LENGTH, most: int = OPEN) -> list[tuple[int, int]]:
    """Bin and offset of each piece, in one stream without a second round."""
    bins = OpenBins(size, most)
    return [bins.put(n) for n in lengths]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and row of parts that the tokenizer splits anyway: runs without ASCII white space, cut between a letter of A-Z and a sign after it.

    The splitting pattern drops white space, and none of its matches goes from a letter on to a sign. The normal form and lower case of either side don't depend on the other.
    """
    starts, ends, rows = T.spans(T.DARK[data], offsets)
    if not len(starts):
        return starts, rows
    edge = np.zeros(len(data), bool)
    edge[1:] = _LETTER[data[:-1]] & _SIGN[data[1:]]
    edge[starts] = False
    cuts = np.flatnonzero(edge)
    owner = np.searchsorted(starts, cuts, "right") - 1
    inside = cuts < ends[owner]  # not where a text ends and the next begins
    starts = np.sort(np.concatenate([starts, cuts[inside]]))
    return starts, np.searchsorted(offsets, starts, "right") - 1


def encode(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by the end id, and the number of ids of each. Each different word is encoded once."""
    n = len(offsets) - 1
    starts, rows = word_starts(data, offsets)
    if not len(starts):
        return np.full(n, END, np.uint32), np.ones(n, np.int64)
    # a word here goes up to the start of the next one: the white space behind it has no ids
    edges = np.append(starts, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    which = words.indices.to_numpy()
    coded = Words.of(path).ids([w.strip(_BLANKS) for w in words.dictionary.to_pylist()])
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    flat = np.frombuffer(b"".join(coded), np.uint32)
    at = np.cumsum(sizes) - sizes
    per_word = sizes[which]
    counts = np.bincount(rows, weights=per_word, minlength=n).astype(np.int64) + 1
    out = np.full(int(counts.sum()), END, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts) - 1] = False
    out[keep] = flat[T.ragged(at[which], per_word)]
    return out, counts


def cut(ids: np.ndarray, counts: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of each piece, and its CRC-32; a text of ``size`` ids or less is one piece."""
    pieces = np.maximum(1, -(-counts // size))
    rows = np.repeat(np.arange(len(counts)), pieces)
    starts = T.ragged(np.zeros(len(counts), np.int64), pieces) * size
    lengths = np.minimum(size, counts[rows] - starts)
    raw, at = memoryview(ids.astype("<u4").tobytes()), (np.cumsum(counts) - counts)[rows] + starts
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + lengths).tolist(), strict=True)]
    return rows, starts, lengths, np.array(crc, np.int64)


def packed(df: DataFrame, path: str | None = None, size: int = LENGTH, most: int = OPEN) -> DataFrame:
    """Per piece of the texts of ``df`` (doc_id, text): ids before it in its document, length, CRC-32 of its ids, sequence and place in it.

    A null or empty text is the end id alone and is packed like any other; repeated rows and rows without an id are packed
    each; a text longer than ``size`` gives full pieces and a rest; an empty table gives no rows; only doc_id and text are read.
    """
    path = path or tokenizer_path()

    def first(batches: Iterator[pa.RecordBatch]):
        bins = OpenBins(size, most, TaskContext.get().partitionId() * _TASK)
        waiting: list[pa.RecordBatch] = []
        for whole in batches:
            for batch in T.portions(whole, "text", 4 << 20):
                rows, starts, lengths, crc = cut(*encode(*T.column(batch.column("text")), path), size)
                places = [bins.put(n) for n in lengths.tolist()]
                starts_at = np.searchsorted(rows, rows)
                waiting.append(_batch(batch.column("doc_id").take(pa.array(rows)), np.arange(len(rows)) - starts_at, starts, lengths, crc, places))
        still = bins.open()
        for own in waiting:
            left = [s in still for s in own.column("sequence_id").to_pylist()]
            yield own.append_column("left", pa.array(left, pa.bool_()))

    rows = staged(docs.texts(df).mapInArrow(first, f"{PACKED}, left boolean"))
    n_left = rows.where("left").count()  # one number
    left = rows.where("left").repartition(max(1, -(-n_left // AGAIN_ROWS)), F.xxhash64("sequence_id"))
    ordered = left.sortWithinPartitions(F.desc("length"), "sequence_id", "offset").drop("left")

    def again(batches: Iterator[pa.RecordBatch]):
        bins = OpenBins(size, most, _AGAIN + TaskContext.get().partitionId() * _TASK)
        for batch in batches:
            places = [bins.put(n) for n in batch.column("length").to_pylist()]
            yield _batch(batch.column("doc_id"), *(np.asarray(batch.column(k)) for k in ("piece", "start", "length", "ids_crc32")), places)

    return rows.where(~F.col("left")).drop("left").unionByName(ordered.mapInArrow(again, PACKED))


def _batch(doc_id: pa.Array, piece: np.ndarray, start: np.ndarray, length: np.ndarray, crc: np.ndarray, places: list[tuple[int, int]]) -> pa.RecordBatch:
    where = np.array(places, np.int64).reshape(-1, 2)
    columns = [doc_id, pa.array(piece.astype(np.int32)), *(pa.array(np.ascontiguousarray(x, np.int64)) for x in (start, length, crc, where[:, 0], where[:, 1]))]
    return pa.RecordBatch.from_arrays(columns, names=[p.split()[0] for p in PACKED.split(", ")])


def op11(spark: SparkSession, path: str) -> DataFrame:
    return packed(docs.table(spark, path, "documents"))


docs.register("op11_best_fit", op11)
