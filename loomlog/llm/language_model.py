"""Language-model scores by context-tree weighting over bytes (operator 3).

Each byte is eight binary decisions. A decision is a node: the bits of the byte so far, under a context of the last d bytes, d = 0 ... ``DEPTH``.
Every node counts zeros and ones in the training texts and gives the Krichevsky-Trofimov estimate; a node's weighted probability is the mean of
its own estimate and of the product over its longer contexts. As both depend on counts only, the trees are computed bottom up with
grouped sums, one depth after the other, and mixed top down: no text order, no single place that holds the model. Grams that end in the same
``SHARED`` bytes of context hold all nodes under longer contexts, so those stay in one task; the nodes above are summed and joined over all tasks.

Texts are scored in blocks of about ``BLOCK`` bytes. A block sends each different (DEPTH + 1)-gram and word it holds once, and gets back that gram's log
probability and that word's count. Both go by parts: one row holds what a block asks of a part, as differences of ascending keys, byte planes apart
and compressed, and the answer holds values alone, in the same order. What moves grows with the corpus; a task holds one block or one part. A text begins after DEPTH zero bytes and ends
with one; A-Z are lower-cased. Text longer than a block is cut after a blank and keeps its context.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from loomlog.llm import documents as docs
from loomlog.llm import text as T
from loomlog.plans.stage import staged

DEPTH = 5
BLOCK = 16 << 20
PART = 1 << 20
HELD_OUT, MODULUS = 2, 7

BLOCKS = "block long, rows array<long>, doc_ids array<long>, held array<boolean>, sizes array<long>, ends array<boolean>, before binary, raw binary"
_BLANK = ~T.DARK


# ---------------------------------------------------------------------------------------------------------------
# Blocks of text


def cuts(data: np.ndarray, size: int) -> list[int]:
    """Where to end the pieces of a text: after the first blank at or beyond each ``size`` bytes, and at its end."""
    out, at = [], 0
    while len(data) - at > size:
        rest = at + size
        while rest < len(data):
            found = np.flatnonzero(_BLANK[data[rest : rest + size]])
            if len(found):
                rest += int(found[0]) + 1
                break
            rest += size
        if rest >= len(data):
            break
        out.append(rest)
        at = rest
    return [*out, len(data)]


def blocks(df: DataFrame, depth: int, size: int = BLOCK) -> DataFrame:
    """Texts in blocks, compressed, with a number for each row of ``df``."""
    rows = docs.texts(df).withColumn("held", docs.remainder("doc_id", MODULUS) == HELD_OUT)

    def run(batches: Iterator[pa.RecordBatch]):
        block, row = TaskContext.get().partitionId() << 32, TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        total = 0
        for batch in batches:
            data, offsets = T.column(batch.column("text"))
            ids, flags = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
            for i in range(batch.num_rows):
                own = T.FOLD[data[offsets[i] : offsets[i + 1]]]
                start = 0
                for end in cuts(own, size):
                    before = own[max(0, start - depth) : start].tobytes().rjust(depth, b"\0")
                    held.append((row, ids[i], flags[i], end - start, end == len(own), before, own[start:end]))
                    total, start = total + end - start, end
                    if total >= size:
                        yield _block(block, held)
                        block, held, total = block + 1, [], 0
                row += 1
        if held:
            yield _block(block, held)

    return rows.mapInArrow(run, BLOCKS)


def _block(block: int, held: list[tuple]) -> pa.RecordBatch:
    raw = pa.compress(np.concatenate([h[6] for h in held]).tobytes(), codec="zstd", asbytes=True)
    columns = [
        pa.array([block], pa.int64()), *[pa.array([[h[k] for h in held]], pa.list_(kind)) for k, kind in enumerate([pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()])],
        pa.array([b"".join(h[5] for h in held)], pa.binary()), pa.array([raw], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[p.split()[0] for p in BLOCKS.split(", ")])


class Block:
    """One block, unpacked: pieces of text, each between its context and, at the end of a text, the closing zero byte."""

    def __init__(self, row: dict, depth: int):
        self.rows, self.doc_ids = np.array(row["rows"], np.int64), row["doc_ids"]
        self.held, self.ends = np.array(row["held"], bool), np.array(row["ends"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.depth, self.n = depth, len(self.rows)
        self.data = np.frombuffer(pa.decompress(row["raw"], int(self.sizes.sum()), codec="zstd", asbytes=True), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.before = np.frombuffer(row["before"], np.uint8)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the different grams, ascending, and for each place of the line the number of the gram that ends there.

        Places without a gram (the contexts before the pieces) have a number one beyond the last. Each step numbers the (k + 1)-grams by the number of
        the k-gram before and the next byte; wide arrays are made for ``PART`` places at a time.
        """
        d = self.depth
        full = d + self.sizes + self.ends
        heads = np.cumsum(full) - full
        before = (heads[:, None] + np.arange(d)).ravel()
        inside = np.ones(int(full.sum()), bool)
        inside[before] = False
        inside[(heads + full - 1)[self.ends]] = False
        line = np.zeros(len(inside), np.uint8)
        line[before] = self.before
        line[inside] = self.data
        del inside
        present = np.zeros(256, bool)
        present[line] = present[0] = True
        letters = np.flatnonzero(present)
        code = np.zeros(256, np.uint8)
        code[letters] = np.arange(len(letters))
        codes, keys = code[line], letters.astype(np.int64)
        del line
        ids = codes.astype(np.int32)
        for _ in range(d):
            seen = np.zeros(-(-len(keys) * len(letters) // 64) * 64, bool)
            for i in range(len(ids) - 1, 0, -PART):  # from the end, as ids are replaced where they stand
                low = max(1, i - PART + 1)
                pair = ids[low - 1 : i].astype(np.int64) * len(letters) + codes[low : i + 1]
                seen[pair] = True
            found = np.flatnonzero(seen)
            marks = np.packbits(seen, bitorder="little").view(np.uint64)  # a pair's number is how many are seen before it
            del seen
            lower = (np.cumsum(np.bitwise_count(marks), dtype=np.int32) - np.bitwise_count(marks)).astype(np.int32)
            for i in range(len(ids) - 1, 0, -PART):
                low = max(1, i - PART + 1)
                pair = ids[low - 1 : i].astype(np.int64) * len(letters) + codes[low : i + 1]
                at = pair >> 6
                ids[low : i + 1] = lower[at] + np.bitwise_count(marks[at] & ((np.uint64(1) << (pair & 63).astype(np.uint64)) - np.uint64(1)))
            ids[0] = 0
            keys = (keys[found // len(letters)] << 8) | letters[found % len(letters)]
        used = np.zeros(len(keys) + 1, bool)
        outside = np.ones(len(ids), bool)
        outside[before] = False
        for i in range(0, len(ids), PART):
            used[ids[i : i + PART][outside[i : i + PART]]] = True
        again = (np.cumsum(used) - 1).astype(np.int32)
        kept = keys[used[:-1]]
        for i in range(0, len(ids), PART):
            ids[i : i + PART] = again[ids[i : i + PART]]
        ids[before] = len(kept)
        return kept, ids

    def of_pieces(self, values: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Sums of the values of the numbers over the places of each piece."""
        full = self.depth + self.sizes + self.ends
        heads = np.concatenate([[0], np.cumsum(full)])
        out, at = np.empty(self.n), 0
        while at < self.n:  # whole pieces of ``PART`` places together
            end = max(at + 1, int(np.searchsorted(heads, heads[at] + PART, "right")) - 1)
            out[at:end] = np.add.reduceat(values[number[heads[at] : heads[end]]], heads[at:end] - heads[at])
            at = end
        return out

    def taught(self, number: np.ndarray, n: int) -> np.ndarray:
        """How often each of the n numbers stands in training texts."""
        taught = np.repeat(~self.held, self.depth + self.sizes + self.ends)
        out = np.zeros(n + 1, np.int64)
        for i in range(0, len(number), PART):
            out += np.bincount(number[i : i + PART][taught[i : i + PART]], minlength=n + 1)
        return out[:n]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the different words, ascending; for each word its number and the piece it is in."""
        _, _, _, rows, hashes = T.words(self.data, self.offsets, T.DARK)
        hashes = hashes.view(np.int64)
        order = np.argsort(hashes)
        ordered = hashes[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        return ordered[fresh], number, rows


WORD, GRAM = 0, 1
SYMBOLS = "block long, part int, keys binary, n binary"
ANSWERS = t.StructType([t.StructField("block", t.LongType()), t.StructField("part", t.IntegerType()), t.StructField("kind", t.IntegerType()), t.StructField("values", t.BinaryType()), t.StructField("fresh", t.LongType())])
MIX = 40503  # odd, and small enough for products of 48 bits


def _pack(values: np.ndarray) -> bytes:
    """Eight-byte numbers, their first bytes together, then their second, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys; the differences go round where they leave 64 bits, and come back by the same sum."""
    return len(keys).to_bytes(8, "little") + _pack(np.diff(keys.view(np.uint64), prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data[8:], int.from_bytes(data[:8], "little"), np.uint64), dtype=np.uint64).view(np.int64)


def _gram_part(key, depth: int, parts: int):
    """Part of a gram by its first half, so that neighbours stay together; ``key`` is an array or a column."""
    half = 8 * ((depth + 1) // 2)
    if isinstance(key, Column):
        mixed = F.shiftright(key, half) * F.lit(MIX).cast("long")
        return F.pmod(mixed.bitwiseXOR(F.shiftright(mixed, 15)), F.lit(parts).cast("long")).cast("int")
    mixed = (key >> half) * MIX
    return (mixed ^ (mixed >> 15)) % parts


def _parted(kind: int, keys: np.ndarray, depth: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The parts of ascending keys: for each its number and the places of its keys, in their order."""
    part = _gram_part(keys, depth, parts) if kind == GRAM else (keys & 0x7FFFFFFF) % parts
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), order[edges[p] : edges[p + 1]]


def _symbols(table: DataFrame, depth: int, kind: int, parts: int) -> DataFrame:
    """(block, part, keys, n): the different grams or words of each block and how often they stand in its training texts, a row for each part."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Block(row, depth)
                if kind == GRAM:
                    keys, number = own.grams()
                    n = own.taught(number, len(keys))
                else:
                    keys, number, piece = own.words()
                    n = np.bincount(number[~own.held[piece]], minlength=len(keys))
                del number
                for part, mine in _parted(kind, keys, depth, parts):
                    columns = [pa.array([row["block"]], pa.int64()), pa.array([part], pa.int32()), pa.array([_pack_keys(keys[mine])], pa.binary()), pa.array([_pack(n[mine])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "keys", "n"])

    return table.mapInArrow(run, SYMBOLS)


def _sums(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The different keys of a part, ascending, their counts over all blocks, and the keys each block asked for."""
    own = [_unpack_keys(k) for k in asked.column("keys").to_pylist()]
    n = np.concatenate([_unpack(x, len(k), np.int64) for x, k in zip(asked.column("n").to_pylist(), own, strict=True)])
    every = np.concatenate(own)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(n[order], first), own


def _counted(asked: pa.Table) -> pa.Table:
    keys, n, _ = _sums(asked)
    return pa.table([pa.array(keys), pa.array(n)], names=["key", "n"])


def _answers(asked: pa.Table, kind: int, values: list[bytes], fresh: list[int]) -> pa.Table:
    kinds = pa.array([kind] * asked.num_rows, pa.int32())
    return pa.table([asked.column("block"), asked.column("part"), kinds, pa.array(values, pa.binary()), pa.array(fresh, pa.int64())], names=ANSWERS.names)


def _word_answers(asked: pa.Table) -> pa.Table:
    """log10(count + 1) of the words each block asked for; one block of the part tells how many trained words it has."""
    keys, n, own = _sums(asked)
    value = np.log10(n + 1.0)
    return _answers(asked, WORD, [_pack(value[np.searchsorted(keys, k)]) for k in own], [int((n > 0).sum())] + [0] * (asked.num_rows - 1))


def _gram_answers(asked: pa.Table, known: pa.Table) -> pa.Table:
    if not asked.num_rows:
        return ANSWERS_NONE
    keys, values = known.column("key").to_numpy(), known.column("value").to_numpy()
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    out = []
    for k in map(_unpack_keys, asked.column("keys").to_pylist()):
        at = np.searchsorted(keys, k)
        if not np.array_equal(keys[np.minimum(at, len(keys) - 1)], k):
            raise ValueError("a block's grams have changed since they were counted")
        out.append(_pack(values[at]))
    return _answers(asked, GRAM, out, [0] * len(out))


ANSWERS_NONE = pa.table([pa.array([], k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())], names=ANSWERS.names)


# ---------------------------------------------------------------------------------------------------------------
# The model


SHARED = 2  # nodes under longer contexts are kept together by so many last bytes
TREE_ROWS = 1 << 18


def _log_gamma(x, log=F.log):
    """Stirling's series at x + 8, brought down again; good to ten digits from x = 1/2 on."""
    z = x + 8.0
    series = (z - 0.5) * log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return series - log(product)


def _estimate(n0, n1, log=F.log):
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones in any order."""
    value = _log_gamma(n0 + 0.5, log) + _log_gamma(n1 + 0.5, log) - math.log(math.pi) - _log_gamma(n0 + n1 + 1.0, log)
    return F.when(n0 + n1 == 0, 0.0).otherwise(value) if isinstance(value, Column) else np.where(n0 + n1 == 0, 0.0, value)


class Subtrees:
    """Nodes of ``i`` bits under contexts of ``depth`` down to ``shared`` bytes, for grams that are alike in their last ``shared`` bytes of context.

    Nodes of a level are numbered by context and bits; ``up`` has, for each gram, its node of the deepest level, and for each node of a level its parent.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, i: int, depth: int, shared: int):
        last = keys & 255
        self.bit = ((last >> (7 - i)) & 1).astype(bool)
        self.at, place = np.unique((keys & ~255) | (1 << i) | (last >> (8 - i)), return_inverse=True)
        self.up, self.levels = [place], []
        n0, n1 = (np.bincount(place, weights=np.where(self.bit == b, n, 0), minlength=len(self.at)) for b in (False, True))
        self.weighted = own = _estimate(n0, n1, np.log)
        self._add(n0, n1, np.ones(len(n0)))
        for d in range(depth - 1, shared - 1, -1):
            self.at, place = np.unique(self.at & ((1 << (8 * d + 8)) - 1), return_inverse=True)
            self.up.append(place)
            n0, n1, below = (np.bincount(place, weights=w, minlength=len(self.at)) for w in (n0, n1, self.weighted))
            own = _estimate(n0, n1, np.log)
            self.weighted = np.logaddexp(own, below) - math.log(2)
            with np.errstate(over="ignore"):
                self._add(n0, n1, 1 / (1 + np.exp(below - own)))
        self.n0, self.n1 = n0, n1

    def _add(self, n0, n1, share) -> None:
        self.levels.append(((n1 + 0.5) / (n0 + n1 + 1), share))

    def chances(self, p1: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Probability of each gram's bit, from what the shorter contexts of the topmost nodes give and leave."""
        for (kt, share), up in zip(reversed(self.levels), reversed(self.up), strict=True):
            p1, rest = (p1 + rest * share * kt)[up], (rest * (1 - share))[up]
        return np.where(self.bit, p1, 1 - p1)


TOPS = "bucket int, context long, node long, n0 long, n1 long, weighted double"


def _tops(depth: int, shared: int):
    def run(grams: pa.Table) -> pa.Table:
        keys, n = grams.column("key").to_numpy(), grams.column("n").to_numpy()
        each = []
        for i in range(8):
            own = Subtrees(keys, n, i, depth, shared)
            each.append((own.at, own.n0, own.n1, own.weighted))
        at, n0, n1, weighted = map(np.concatenate, zip(*each, strict=True))
        bucket = np.full(len(at), grams.column("bucket")[0].as_py(), np.int32)
        return pa.table([bucket, at >> 8, at & 255, n0.astype(np.int64), n1.astype(np.int64), weighted], names=[c.split()[0] for c in TOPS.split(", ")])

    return run


def _valued(depth: int, shared: int):
    def run(grams: pa.Table, above: pa.Table) -> pa.Table:
        keys, n = grams.column("key").to_numpy(), grams.column("n").to_numpy()
        at = (above.column("context").to_numpy() << 8) | above.column("node").to_numpy()
        order = np.argsort(at)
        at, p1, rest = at[order], above.column("p1").to_numpy()[order], above.column("rest").to_numpy()[order]
        value = np.zeros(len(keys))
        for i in range(8):
            own = Subtrees(keys, n, i, depth, shared)
            mine = np.searchsorted(at, own.at)
            value += np.log10(own.chances(p1[mine], rest[mine]))
        return pa.table([keys, value], names=["key", "value"])

    return run


def _upper(tops: DataFrame, shared: int) -> list[DataFrame]:
    """Counts, own estimate and weighted probability of the nodes under contexts of 0 ... shared - 1 bytes."""
    levels = [tops]
    for d in range(shared - 1, -1, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1))
        up = levels[0].groupBy(shorter.alias("context"), "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        up = up.withColumn("own", _estimate(F.col("n0"), F.col("n1")))
        most, least = F.greatest("own", "below"), F.least("own", "below")
        levels.insert(0, staged(up.withColumn("weighted", most + F.log1p(F.exp(least - most)) - math.log(2))))
    return levels[:-1]


def _mixed(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(bucket, context, node, p1, rest) for the topmost nodes of the subtrees: estimates of all shorter contexts, each with what weight is left
    to it, and the weight left to the subtree."""
    out = None
    for d, level in enumerate([*levels, tops]):
        if d < len(levels):
            share = 1 / (1 + F.exp(F.col("below") - F.col("own")))
            own = level.select("context", "node", ((F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)).alias("kt"), share.alias("share"))
        else:
            own = level.select("bucket", "context", "node")
        if out is None:
            out = own.select("context", "node", (F.col("share") * F.col("kt")).alias("p1"), (1 - F.col("share")).alias("rest"))
            continue
        above = out.select(F.col("context").alias("shorter"), F.col("node").alias("above_node"), "p1", "rest")
        joined = own.join(above, (own["context"].bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1)) == F.col("shorter")) & (own["node"] == F.col("above_node")))
        if d == len(levels):
            return joined.select("bucket", "context", "node", "p1", "rest")
        out = joined.select("context", "node", (F.col("p1") + F.col("rest") * F.col("share") * F.col("kt")).alias("p1"), (F.col("rest") * (1 - F.col("share"))).alias("rest"))


def train(grams: DataFrame, depth: int) -> DataFrame:
    """(key, value): log10 probability of the last byte of each gram after the others, for all grams of the table (key, n).

    Grams with n = 0 are never learnt from; they are carried so that the mixture is known for them too. Grams alike in their last bytes of context
    stand in one bucket, which holds their nodes under longer contexts whole: nodes under shorter ones alone are summed and mixed over all buckets.
    """
    shared = min(SHARED, depth)
    grams = grams if hasattr(grams, "_stage_path") else staged(grams)
    buckets = max(2 * grams.sparkSession.sparkContext.defaultParallelism, -(-grams.count() // TREE_ROWS))
    last = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * shared)) - 1))
    dealt = grams.select("key", "n", F.pmod(F.hash(last), F.lit(buckets)).alias("bucket"))
    tops = staged(dealt.groupBy("bucket").applyInArrow(_tops(depth, shared), TOPS))
    above = _mixed(_upper(tops, shared), tops)
    return dealt.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(_valued(depth, shared), "key long, value double")


# ---------------------------------------------------------------------------------------------------------------
# Scores

PIECES = t.StructType([t.StructField(n, k) for n, k in [("row", t.LongType()), ("doc_id", t.LongType()), ("held", t.BooleanType()), ("ends", t.BooleanType()), ("n_words", t.LongType()), ("n_known", t.LongType()), ("word_sum", t.DoubleType()), ("score", t.DoubleType()), ("n_bytes", t.LongType()), ("new_words", t.LongType())]])


def _score(depth: int, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Block(left.to_pylist()[0], depth)
        sent = {(kind, part): values for kind, part, values in zip(*(right.column(c).to_pylist() for c in ("kind", "part", "values")), strict=True)}

        def looked_up(what: int, known: np.ndarray) -> np.ndarray:
            out = np.empty(len(known))
            for part, mine in _parted(what, known, depth, parts):
                out[mine] = _unpack(sent.pop((what, part)), len(mine), np.float64)
            return out

        known, number, piece = own.words()
        value = looked_up(WORD, known)[number]  # log10(count + 1)
        word_sum, n_words, n_known = np.bincount(piece, weights=value, minlength=own.n), np.bincount(piece, minlength=own.n), np.bincount(piece[value > 0], minlength=own.n)
        del number, piece, value
        known, number = own.grams()
        gram_sum = own.of_pieces(np.append(looked_up(GRAM, known), 0.0), number)
        first = np.zeros(own.n, np.int64)
        first[0] = sum(right.column("fresh").to_pylist())
        return pa.table([pa.array(own.rows), pa.array(own.doc_ids, pa.int64()), pa.array(own.held), pa.array(own.ends), pa.array(n_words.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(word_sum.astype(np.float64)), pa.array(gram_sum), pa.array(own.sizes), pa.array(first)], names=PIECES.names)

    return run


def score(df: DataFrame, depth: int = DEPTH, size: int = BLOCK) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (code length over bytes and end).

    Null and empty texts are the end alone; repeated rows are learnt and scored each; without training rows all estimates are those of
    empty counts. Words are told apart by a 64-bit hash. Only doc_id and text are read.
    """
    table = staged(blocks(df, depth, size))
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, table.count() // 2)
    asked = staged(_symbols(table, depth, GRAM, parts))
    grams = staged(asked.groupBy("part").applyInArrow(_counted, "key long, n long"))
    values = staged(train(grams, depth)).withColumn("part", _gram_part(F.col("key"), depth, parts))
    of_grams = asked.drop("n").groupBy("part").cogroup(values.groupBy("part")).applyInArrow(_gram_answers, ANSWERS)
    of_words = _symbols(table, depth, WORD, parts).groupBy("part").applyInArrow(_word_answers, ANSWERS)
    lookups = of_words.unionByName(of_grams)
    pieces = staged(table.groupBy("block").cogroup(lookups.groupBy("block")).applyInArrow(_score(depth, parts), PIECES))
    trained = ~F.col("held")
    sums = pieces.agg(F.sum(F.when(trained, F.col("n_words"))), F.sum(F.when(trained & F.col("ends"), 1)), F.sum("new_words")).first()
    n_words, n_docs, n_distinct = (x or 0 for x in sums)
    n, v = n_words + n_docs, n_distinct + (n_docs > 0)
    per_row = pieces.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_known", "word_sum", "score", "n_bytes")], F.first("doc_id").alias("doc_id"), F.first("held").alias("held"))
    tokens = F.col("n_words") + 1
    return per_row.select(
        "doc_id", F.col("held").alias("held_out"), tokens.alias("n_tokens"), (F.col("n_known") + int(n_docs > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("word_sum") + math.log10(n_docs + 1) - tokens * math.log10(n + v + 1)).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op3(spark: SparkSession, path: str) -> DataFrame:
    return score(docs.table(spark, path, "documents"))


docs.register("op3_context_tree", op3)
