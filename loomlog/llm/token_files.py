"""Token ids as Simple-8b files in document order (operator 6).

Texts are put in ascending order of doc_id by ranges; a task encodes its range and writes it as a shard: segments of about
``SEGMENT`` ids, each holding two Simple-8b payloads (ids, and ids per document) and the doc_ids. Segments are rows of
Parquet files, so any store Spark can write to will do. Positions over all shards come from one number per shard.

The tokenizers library encodes. Most of a corpus is the same words over and over, so texts are cut into pieces where the
library would split them anyway (before a blank between two visible characters, see ``piece_spans``), and
each worker asks the library once for each piece, as long as its memory of ``REMEMBERED`` pieces lasts.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm import documents as docs
from loomlog.llm import simple8b
from loomlog.llm import text as T
from loomlog.plans.stage import stage_dir

SEGMENT = 1 << 20
SHARD_CHARS = 16 << 20
REMEMBERED = 500_000
END = 0

# First bytes of characters that may be white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000-205F, U+3000).
_WIDE_BLANK_HEADS = (0xC2, 0xE1, 0xE2, 0xE3)
_PLAIN = np.ones(256, bool)
_PLAIN[:0x21] = _PLAIN[0x7F] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b"\n!\"#$%&()*,./:;<=>?@[]_|")] = True  # no letter, no number, and never inside a match that began with letters
_NO_WIDE_HEAD = np.ones(256, bool)
_NO_WIDE_HEAD[list(_WIDE_BLANK_HEADS)] = False
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces:
    """Ids of pieces of text from the tokenizers library; special tokens' strings are ordinary text."""

    _own: dict[str, Pieces] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces, 4 bytes each. Pieces not met for ``REMEMBERED`` others are forgotten."""
        young, old, new = self.young, self.old, []
        for piece in pieces:
            if piece not in young:
                if piece in old:
                    young[piece] = old[piece]
                else:
                    new.append(piece)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for piece, coded in zip(part, self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False), strict=True):
                young[piece] = array("I", coded.ids).tobytes()
        out = [young[p] for p in pieces]
        if len(young) > REMEMBERED:
            self.young, self.old = {}, young
        return out


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of pieces: cut before a blank with a visible character on either side, between a letter of A-Z and a sign that
    follows it, and between a lone line feed and such a letter.

    The splitting pattern takes such a blank as the start of the next match only, ends a run of letters at the sign, and takes a line feed before a
    letter as the end of a match. A character from 0x80 on counts as visible if its first byte cannot begin a white-space character; where
    that is not plain, there is no cut.
    """
    n = len(data)
    blank = np.flatnonzero(data == 0x20)
    blank = blank[(blank > 0) & (blank < n - 1)]
    before, after = data[blank - 1], data[blank + 1]
    fits = _PLAIN[before] & _PLAIN[after] & _NO_WIDE_HEAD[after]
    wide = before >= 0x80  # look back to the first byte of the character
    fits &= ~wide | (_NO_WIDE_HEAD[data[np.maximum(blank - 2, 0)]] & _NO_WIDE_HEAD[data[np.maximum(blank - 3, 0)]] & _NO_WIDE_HEAD[before])
    cuts = blank[fits]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    cuts = cuts[~edge[cuts] & ~edge[cuts + 1]]  # neighbours must be of the same text
    edge[n] = False
    edge[cuts] = True
    letter = _LETTER[data]
    edge[1:n] |= letter[:-1] & _STOP[data[1:]]
    edge[2:n] |= (_PLAIN & (np.arange(256) < 0x80))[data[:-2]] & (data[1:-1] == 0x0A) & letter[2:]
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n) if len(starts) else starts
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def encode(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by the end id, and the number of ids of each."""
    n = len(offsets) - 1
    starts, ends, rows = piece_spans(data, offsets)
    hashes = T.span_hashes(data, starts, ends)
    lengths, raw = ends - starts, data.tobytes()
    group, distinct = pd.factorize(hashes)
    first = np.empty(len(distinct), np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    if len(starts) and not _same_bytes(data, starts, lengths, first[group]):
        first, group = np.arange(len(starts)), np.arange(len(starts))  # two pieces of one hash: take each by itself
    coded = Pieces.of(path).ids([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    flat = np.frombuffer(b"".join(coded), np.uint32)
    at = np.cumsum(sizes) - sizes
    per_piece = sizes[group] if len(starts) else np.zeros(0, np.int64)
    counts = np.bincount(rows, weights=per_piece, minlength=n).astype(np.int64) + 1
    out = np.full(int(counts.sum()), END, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts) - 1] = False
    out[keep] = flat[T.ragged(at[group], per_piece)] if len(starts) else flat
    return out, counts


def _same_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, like: np.ndarray) -> bool:
    """Whether each piece equals the piece that stands for its hash."""
    if (lengths != lengths[like]).any():
        return False
    eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))  # the eight bytes from each place on
    others = np.flatnonzero(like != np.arange(len(starts)))
    left, mine, own = lengths[others], starts[others], starts[like[others]]
    while len(left):
        if ((eight[mine] ^ eight[own]) & _FIRST[np.minimum(left, 8)]).any():
            return False
        more = left > 8
        left, mine, own = left[more] - 8, mine[more] + 8, own[more] + 8
    return True


SEGMENTS = "shard int, segment int, doc_ids binary, nulls binary, sizes binary, ids binary"


def write(df: DataFrame, folder: str, path: str | None = None) -> None:
    """Write the ids of the texts of ``df`` (doc_id, text) to ``folder`` in ascending doc_id order.

    Null ids come first, equal ids by a hash of the text; null and empty texts are the end id alone; an empty table gives no segments.
    """
    path = path or tokenizer_path()
    df = docs.texts(df)
    total = df.agg(F.sum(F.length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]  # ranges are drawn from samples of these two numbers
    ordered = df.withColumn("tie", F.xxhash64("text")).repartitionByRange(int(total // SHARD_CHARS) + 1, *order).sortWithinPartitions(*order)

    def run(batches):
        shard, segment = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0
        for whole in batches:
            for batch in T.portions(whole, "text", 4 << 20):
                ids, counts = encode(*T.column(batch.column("text")), path)
                held.append((batch.column("doc_id"), counts, ids))
                size += len(ids)
                if size >= SEGMENT:
                    yield _segment(shard, segment, held)
                    segment, held, size = segment + 1, [], 0
        if held:
            yield _segment(shard, segment, held)

    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(folder)


def _segment(shard: int, segment: int, held: list[tuple]) -> pa.RecordBatch:
    keys = pa.concat_arrays([h[0] for h in held])
    nulls = np.asarray(keys.is_null())
    row = [
        shard, segment, simple8b.encode(_zigzag(np.asarray(keys.fill_null(0)))), np.packbits(nulls).tobytes(),
        simple8b.encode(np.concatenate([h[1] for h in held])), simple8b.encode(np.concatenate([h[2] for h in held])),
    ]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[p.split()[0] for p in SEGMENTS.split(", ")])


def _zigzag(keys: np.ndarray) -> np.ndarray:
    """First key and differences, so that ascending keys take a few bits; signs go to the lowest bit."""
    steps = np.diff(keys.astype(np.int64), prepend=np.int64(0))
    return ((steps << 1) ^ (steps >> 63)).view(np.uint64)


def _unzigzag(coded: np.ndarray) -> np.ndarray:
    return np.cumsum((coded >> np.uint64(1)).view(np.int64) ^ -(coded & np.uint64(1)).view(np.int64))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), ids (4 bytes each, little-endian)."""
    return _rows(spark, folder, "doc_id long, start long, ids binary", lambda ids: [(pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), "ids")])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the CRC-32 of its ids."""
    import zlib

    def digest(ids: list[np.ndarray]) -> list[tuple]:
        return [(pa.array([len(i) for i in ids], pa.int64()), "n_tokens"), (pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), "ids_crc32")]

    return _rows(spark, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", digest)


def _rows(spark: SparkSession, folder: str, schema: str, columns) -> DataFrame:  # noqa: ANN001
    segments = spark.read.parquet(folder)

    def counted(batches):
        for batch in batches:
            sizes = [int(simple8b.decode(v.as_py()).sum()) for v in batch.column("sizes")]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("segment"), pa.array(sizes, pa.int64())], names=["shard", "segment", "n"])

    sizes = segments.select("shard", "segment", "sizes").mapInArrow(counted, "shard int, segment int, n long")
    # a number per shard, then per segment inside its shard: no window sees more than the numbers of one of them
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inside", inside).join(shards.select("shard", before.alias("before")), "shard").select("shard", "segment", (F.col("before") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                counts = simple8b.decode(row["sizes"]).astype(np.int64)
                keys = _unzigzag(simple8b.decode(row["doc_ids"]))
                nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(keys)).astype(bool)
                ids = np.split(simple8b.decode(row["ids"]).astype(np.uint32), np.cumsum(counts)[:-1])
                start = row["base"] + np.cumsum(counts) - counts
                extra = columns(ids)
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=nulls), pa.array(start), *[c for c, _ in extra]], names=["doc_id", "start", *[n for _, n in extra]])

    return segments.join(F.broadcast(starts) if _few(starts) else starts, ["shard", "segment"]).mapInArrow(run, schema)


def _few(starts: DataFrame, most: int = 1_000_000) -> bool:
    """Whether the table of segments (24 bytes each) is small enough to go to every executor."""
    return starts.limit(most + 1).count() <= most


def op6(spark: SparkSession, path: str) -> DataFrame:
    folder = f"{stage_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs.table(spark, path, "documents"), folder)
    return read_digests(spark, folder)


docs.register("op6_simple8b", op6)
