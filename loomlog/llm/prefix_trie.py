"""The trie of conversation prefixes by splitters and skeleton (operator 12).

A turn is the MD5 of its role and text, a conversation the string of its turns' digests (its path), so a prefix of turns is a prefix of bytes.
Paths, with conv_id behind them, are dealt out by splitters drawn from a sample; equal paths of a hot conversation fall on either side
of a splitter by conv_id. A node that reaches over a splitter is a prefix of the splitter's path: these nodes, the trie of the
splitter paths, are the skeleton, which goes to all tasks (``SKELETON`` nodes at most; beyond that, splitters are left out).
Each shard is sorted and read once with a stack of open nodes. Nodes outside the skeleton lie in one shard and are finished there; of a
skeleton node each shard sends one partial aggregate, and these are added up. The ids that end at a skeleton node are sent in
pieces and hashed in the order of shards, as a digest of one string has to be; only a piece is in memory.

What is gathered is one conversation at a time, some 50 bytes a turn and no texts, and the 39 conversations at most that share their
first turns' donor. A conversation's digests must fit one value (130 million turns).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm import documents as docs
from loomlog.plans.stage import staged

DONOR_EVERY = 20
DONATED = 4  # a conversation takes crc32 of its id modulo this many turns from its donor
SHARD_BYTES = 8 << 20
SAMPLES = 16  # sampled conversations per shard
SAMPLE_BYTES = 64 << 20
SKELETON = 200_000
PIECE = 1 << 16  # ids sent at once
DIGEST = 16
WORD = r"[^\x20\x09-\x0D]+"
_FIRST_ID = -(1 << 63)


# ---------------------------------------------------------------------------------------------------------------
# Conversations


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Per conv_id: path (16 bytes a turn) and words of each turn, the first turns taken from the donor, the conversation whose id is the next lower multiple of 20.

    Turns are in order of ``turn``, nulls first, ties by role and digest; repeated rows are turns each. Null roles and texts are empty. Rows without a conv_id
    belong to no conversation. A conversation without turns of its own left, and without a donor, has an empty path.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")
    )
    donor = F.col("conv_id") - F.col("conv_id") % DONOR_EVERY
    whole = turns.withColumn("donor", donor).repartition("donor").groupBy("donor", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "digest", "words"))).alias("turns"))
    given = F.first(F.when(F.col("conv_id") == F.col("donor"), F.slice("turns", 1, DONATED - 1)), ignorenulls=True).over(Window.partitionBy("donor"))
    n = docs.remainder("conv_id", DONATED).cast("int")
    none = F.slice("turns", 1, 0)
    both = F.concat(F.slice(F.coalesce(given, none), F.lit(1), n), F.slice("turns", n + 1, F.size("turns")))
    return whole.select("conv_id", both.alias("turns")).select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")
    )


# ---------------------------------------------------------------------------------------------------------------
# Splitters and their trie


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of leading turns that two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    low, high = 0, n // DIGEST - 1  # the first low turns are equal, those up to high + 1 are not
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * DIGEST] == b[: middle * DIGEST] else (low, middle - 1)
    return low


@dataclass
class Skeleton:
    """Trie of the splitter paths; node 0 is the root."""

    splitters: list[tuple[bytes, int]] = field(default_factory=list)
    child: dict[tuple[int, bytes], int] = field(default_factory=dict)
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    words: list[int] = field(default_factory=lambda: [0])

    def add(self, path: bytes, words: list[int]) -> None:
        node = 0
        for d in range(len(path) // DIGEST):
            key = (node, path[d * DIGEST : (d + 1) * DIGEST])
            if key not in self.child:
                self.child[key] = len(self.parent)
                self.parent.append(node)
                self.depth.append(d + 1)
                self.words.append(words[d])
            node = self.child[key]

    def children(self) -> list[int]:
        out = [0] * len(self.parent)
        for p in self.parent[1:]:
            out[p] += 1
        return out

    def words_below(self) -> list[int]:
        """Words of the last texts of all skeleton nodes of a subtree, each once. Children have higher numbers than their parents."""
        out = list(self.words)
        for node in range(len(out) - 1, 0, -1):
            out[self.parent[node]] += out[node]
        return out


def skeleton(sample: list[tuple[bytes, int, list[int]]], shards: int, most: int = SKELETON) -> Skeleton:
    """Splitters at equal steps of the sampled (path, conv_id, words), each cut behind the first turn that tells it from the sample before it."""
    sample = sorted(sample, key=lambda s: s[:2])
    while True:
        out = Skeleton()
        at = sorted({k * len(sample) // shards for k in range(1, shards)} - {0}) if sample else []
        for i in at:
            (before, _, _), (path, key, words) = sample[i - 1], sample[i]
            splitter = (path, key)
            if before != path:
                path = path[: (shared_turns(before, path) + 1) * DIGEST]
                splitter = (path, _FIRST_ID)
            out.splitters.append(splitter)
            out.add(path, words)
            if len(out.parent) > most:
                break
        if len(out.parent) <= most:
            return out
        shards //= 2


# ---------------------------------------------------------------------------------------------------------------
# Shards


class _Node:
    __slots__ = ("children", "depth", "ends", "leaves", "n", "pending", "saved", "skeleton", "smallest", "words")

    def __init__(self, depth: int, words: int, skeleton: int):
        self.depth, self.words, self.skeleton = depth, words, skeleton
        self.n = self.children = self.leaves = self.saved = 0
        self.smallest = 1 << 63
        self.ends = None  # a digest, or ids of a skeleton node
        self.pending: list[list] = []  # finished children that wait for this node's smallest member


_PARTS = "kind int, node int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard int, piece int, ids binary"
_LOCAL, _PARTIAL, _ENDS = range(3)
_NOTHING = hashlib.sha256(b"").hexdigest()


class Shard:
    """Reads sorted conversations of one shard; ``rows`` holds what is finished."""

    def __init__(self, trie: Skeleton, number: int, rows: list[tuple]):
        self.trie, self.number, self.rows = trie, number, rows
        self.stack = [_Node(0, 0, 0)]
        self.path = b""
        self.pieces = 0

    def add(self, path: bytes, conv_id: int, words: list[int]) -> None:
        stack = self.stack
        shared = shared_turns(self.path, path)
        while len(stack) - 1 > shared:
            self.close()
        for d in range(shared, len(path) // DIGEST):
            above = stack[-1].skeleton
            own = -1 if above < 0 else self.trie.child.get((above, path[d * DIGEST : (d + 1) * DIGEST]), -1)
            stack.append(_Node(d + 1, words[d], own))
        last = stack[-1]
        last.n += 1
        last.smallest = min(last.smallest, conv_id)
        if last.skeleton >= 0:
            last.ends = last.ends or []
            last.ends.append(str(conv_id))
            if len(last.ends) == PIECE:
                self.send(last)
        elif last.ends is None:
            last.ends = hashlib.sha256(str(conv_id).encode())
        else:
            last.ends.update(b",%d" % conv_id)
        self.path = path

    def send(self, node: _Node) -> None:
        self.rows.append((_ENDS, node.skeleton, *[None] * 8, self.number, self.pieces, ",".join(node.ends).encode()))
        self.pieces += 1
        node.ends = None

    def close(self) -> None:
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if node.skeleton >= 0:
            if node.ends:
                self.send(node)
            node.saved += node.n * node.words  # the one that is not saved is taken off once for all shards
            self.rows.append((_PARTIAL, node.skeleton, node.smallest, node.depth, None, node.n, node.children, node.leaves, node.saved, None, None, None, None))
        else:
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.words
            for row in node.pending:
                row[4] = node.smallest
                self.rows.append(tuple(row))
            row = [_LOCAL, None, node.smallest, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends.hexdigest() if node.ends else _NOTHING, None, None, None]
            above.children += 1
            if above.skeleton >= 0:
                row[1] = above.skeleton
                self.rows.append(tuple(row))
            else:
                above.pending.append(row)
        if above is not None:
            above.n += node.n
            above.leaves += node.leaves
            above.saved += node.saved
            above.smallest = min(above.smallest, node.smallest)

    def end(self) -> None:
        while self.stack:
            self.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [p.split() for p in _PARTS.split(", ")]
    columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def prefix_nodes(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """All nodes of the trie over (conv_id, path, words); an empty table has none, not even a root."""
    spark = paths.sparkSession
    paths = staged(paths)
    n, size, longest = paths.agg(F.count("*"), F.coalesce(F.sum(F.length("path") + 64), F.lit(0)), F.coalesce(F.max(F.length("path")), F.lit(0))).first()
    if shards is None:
        shards = max(-(-size // SHARD_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100 + 1))
    # the smallest hashes of ids are the sample; very long paths make it smaller, never larger than SAMPLE_BYTES
    drawn = min(SAMPLES * shards, SAMPLE_BYTES // (2 * longest + 64))
    few = paths.orderBy(F.xxhash64("conv_id"), "conv_id").limit(drawn).collect() if shards > 1 and drawn else []
    trie = skeleton([(bytes(r.path), r.conv_id, r.words) for r in few], shards)
    held = spark.sparkContext.broadcast(trie)

    def deal(batches: Iterator[pa.RecordBatch]):
        splitters = held.value.splitters
        for batch in batches:
            own = [bisect_right(splitters, key) for key in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)]
            yield batch.append_column("shard", pa.array(own, pa.int32()))

    def read(batches: Iterator[pa.RecordBatch]):
        rows: list[tuple] = []
        shard = None
        for batch in batches:
            for number, path, key, words in zip(*(batch.column(k).to_pylist() for k in ("shard", "path", "conv_id", "words")), strict=True):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.end()
                    shard = Shard(held.value, number, rows)
                shard.add(path, key, words)
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows.clear()
        if shard is not None:
            shard.end()
        if rows:
            yield _batch(rows)

    dealt = paths.select("conv_id", "path", "words").mapInArrow(deal, "conv_id long, path binary, words array<int>, shard int")
    parts = staged(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(read, _PARTS))
    names = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    reduced = staged(parts.where(F.col("kind") == _PARTIAL).groupBy("node").agg(F.min("conv_id").alias("conv_id"), *(F.sum(k).alias(k) for k in names)))
    members = reduced.select(F.col("node"), F.col("conv_id").alias("above"))  # SKELETON rows of 12 bytes at most
    local = parts.where(F.col("kind") == _LOCAL).join(F.broadcast(members), "node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    columns = ["conv_id", "depth", "parent_conv_id", *names, "ends_sha256"]
    return local.select(columns).unionByName(_skeleton_nodes(reduced, parts, trie, held).select(columns))


def _skeleton_nodes(reduced: DataFrame, parts: DataFrame, trie: Skeleton, held) -> DataFrame:  # noqa: ANN001
    """The skeleton's own rows: added partials, what the skeleton's nodes are to each other, and the digests of their ends."""
    spark = reduced.sparkSession

    def leaves(batches):
        own = held.value
        inner = set(own.parent)
        below = [0] * len(own.parent)
        for batch in batches:
            for node in batch.column("node").to_pylist():
                below[node] = int(node not in inner)
        for node in range(len(below) - 1, 0, -1):
            below[own.parent[node]] += below[node]
        found = [node for node, n in enumerate(below) if n]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([below[node] for node in found], pa.int64())], names=["node", "leaves"])

    def digests(batches):
        node, own = None, None
        for batch in batches:
            for number, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if number != node:
                    if own is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([own.hexdigest()])], names=["node", "ends"])
                    node, own = number, hashlib.sha256(ids)
                else:
                    own.update(b"," + ids)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([own.hexdigest()])], names=["node", "ends"])

    plain = pa.table({"node": pa.array(range(len(trie.parent)), pa.int32()), "parent": pa.array(trie.parent, pa.int32()), "depth": pa.array(trie.depth, pa.int64()), "inner": pa.array(trie.children(), pa.int64()), "once": pa.array(trie.words_below(), pa.int64())})
    known = spark.createDataFrame(plain)
    childless = reduced.where(F.col("n_children") == 0).select("node").mapInArrow(leaves, "node int, leaves long").groupBy("node").agg(F.sum("leaves").alias("childless"))
    ends = parts.where(F.col("kind") == _ENDS).select("node", "shard", "piece", "ids").repartition("node").sortWithinPartitions("node", "shard", "piece").mapInArrow(digests, "node int, ends string")
    above = reduced.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    joined = reduced.join(known, "node").join(childless, "node", "left").join(ends, "node", "left").join(above, "parent", "left")
    return joined.withColumns({
        "n_children": F.col("n_children") + F.col("inner"), "n_leaves": F.col("n_leaves") + F.coalesce("childless", F.lit(0)),
        "saved_tokens": F.col("saved_tokens") - F.col("once"), "ends_sha256": F.coalesce("ends", F.lit(_NOTHING)),
    })


def op12(spark: SparkSession, path: str) -> DataFrame:
    return prefix_nodes(rebuilt(docs.table(spark, path, "conversations")))


OP12_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, role, md5(length(role) || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
own AS MATERIALIZED (SELECT conv_id, list(key ORDER BY turn NULLS FIRST, role, key) AS ks, list(words ORDER BY turn NULLS FIRST, role, key) AS ws FROM k GROUP BY conv_id),
h AS (SELECT *, CAST(xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS BIGINT) AS h FROM own),
re AS (SELECT h.conv_id, coalesce(d.ks[1 : h], []) || h.ks[h + 1 :] AS ks, coalesce(d.ws[1 : h], []) || h.ws[h + 1 :] AS ws FROM h LEFT JOIN own AS d ON d.conv_id = h.conv_id - h.conv_id % 20),
pre AS (SELECT conv_id, d, len(ks) AS n, array_to_string(ks[1 : d], '') AS p, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM re, unnest(range(0, len(ks) + 1)) AS u(d)),
nodes AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CASE WHEN d = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends FROM pre GROUP BY p, d),
kids AS (SELECT p[1 : 32 * (d - 1)] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
each AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)),
sums AS (SELECT p[1 : 32 * up] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved FROM each, unnest(range(0, d + 1)) AS u(up) GROUP BY 1)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(e.n_convs AS BIGINT) AS n_convs, CAST(e.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, e.ends AS ends_sha256
FROM each AS e JOIN sums USING (p) LEFT JOIN nodes AS a ON e.d > 0 AND a.p = e.p[1 : 32 * (e.d - 1)]"""

docs.register("op12_prefix_trie", op12, OP12_SQL)
