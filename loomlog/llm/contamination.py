"""Benchmark decontamination by Wu-Manber search over words (operator 2).

Texts become sequences of 64-bit word hashes. Patterns are windows of ``window`` words of the benchmark items (a shorter
item is one pattern of its own length). For each pattern length m there is a table of shifts: the hash of the two-word block
that ends at a position tells how many words no pattern can end at, and the scan jumps over them. Where the shift
is zero, the block's bucket lists the patterns that end in it; all their words are compared, and what remains is confirmed by comparing
the words themselves, byte by byte.

The scan is map-only: documents stay where they are read. Patterns travel in blocks of at most ``BLOCK`` patterns each
(some 20 MB), one pass over the batch per block, however many items there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import documents as docs
from loomlog.llm import text as T

WINDOW = 10
BLOCK = 100_000
LANE = 256
_STEP = np.uint64(0xD6E8FEB86659FD93)

OCCURRENCES = "doc_id long, n_words long, n_hit long, items array<string>"


@dataclass
class Patterns:
    """Patterns of one length: word hashes (n x m), sorted by the block they end in, with bytes and items."""

    length: int
    words: np.ndarray
    blocks: np.ndarray  # sorted distinct hashes of all two-word blocks
    shifts: np.ndarray  # of each of them
    ends: np.ndarray  # hash of the last block of each pattern, sorted
    raw: list[bytes]  # the words, joined by a zero byte
    items: list[tuple[str, ...]]


def _pairs(words: np.ndarray) -> np.ndarray:
    """Hash of the two words that end at each position; of one word where the pattern has no more."""
    return T.mix(words[..., :-1] * _STEP + words[..., 1:])


def compile_patterns(found: dict[tuple[bytes, ...], set[str]]) -> list[Patterns]:
    """Shift tables and buckets of a block of patterns, one set for each length."""
    by_length: dict[int, list[tuple[bytes, ...]]] = {}
    for pattern in found:
        by_length.setdefault(len(pattern), []).append(pattern)
    out = []
    for m, patterns in sorted(by_length.items()):
        data = np.frombuffer(b"\0".join(b"\0".join(p) for p in patterns), np.uint8)
        _, _, _, _, hashes = T.words(data, np.array([0, len(data)]))
        grid = hashes.reshape(len(patterns), m)
        blocks = _pairs(grid) if m > 1 else T.mix(grid)
        width = blocks.shape[1]
        order = np.argsort(blocks[:, -1], kind="stable")
        flat = np.column_stack([blocks.ravel(), np.tile(np.arange(width - 1, -1, -1, dtype=np.uint64), len(patterns))])
        flat = flat[np.lexsort((flat[:, 1], flat[:, 0]))]
        keys, first = np.unique(flat[:, 0], return_index=True)
        out.append(Patterns(m, grid[order], keys, flat[first, 1].astype(np.int64), blocks[order, -1], [b"\0".join(patterns[i]) for i in order], [tuple(sorted(found[patterns[i]])) for i in order]))
    return out


def scan(p: Patterns, words: np.ndarray, row_starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last word, pattern) of all places where the hashes of a pattern's words stand.

    The words are cut into lanes that overlap by m - 1; all lanes advance together, each by its own shift.
    """
    m, n = p.length, len(words)
    none = np.zeros(0, np.int64)
    if n < m:
        return none, none
    first = np.arange(m - 1, n, LANE, dtype=np.int64)  # a lane looks at the places where a pattern may end
    stop = np.minimum(first + LANE, n)
    pos, width = first.copy(), max(m - 1, 1)
    hits = []
    while len(pos):
        block = T.mix(words[pos - 1] * _STEP + words[pos]) if m > 1 else T.mix(words[pos])
        at = np.searchsorted(p.blocks, block)
        at[at == len(p.blocks)] = 0
        shift = np.where(p.blocks[at] == block, p.shifts[at], width)
        hits.append(pos[shift == 0])
        pos = pos + np.maximum(shift, 1)
        keep = pos < stop
        pos, stop = pos[keep], stop[keep]
    last = np.sort(np.concatenate(hits))
    last = last[last - m + 1 >= row_starts[rows[last]]]  # no pattern spans two texts
    block = T.mix(words[last - 1] * _STEP + words[last]) if m > 1 else T.mix(words[last])
    lo, hi = np.searchsorted(p.ends, block, "left"), np.searchsorted(p.ends, block, "right")
    last, which = np.repeat(last, hi - lo), T.ragged(lo, hi - lo)
    for k in range(m):  # direct comparison, word for word
        same = words[last - m + 1 + k] == p.words[which, k]
        last, which = last[same], which[same]
    return last, which


def search(tables: list[list[Patterns]], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Words, words hit and items of each text."""
    folded, starts, ends, rows, words = T.words(data, offsets)
    n = len(offsets) - 1
    n_words = np.bincount(rows, minlength=n).astype(np.int64)
    row_starts = np.cumsum(n_words) - n_words
    edge = np.zeros(len(words) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(n)]
    for block in tables:
        for p in block:
            for end, which in zip(*scan(p, words, row_starts, rows), strict=True):
                at = slice(end - p.length + 1, end + 1)
                if b"\0".join(folded[a:b].tobytes() for a, b in zip(starts[at], ends[at], strict=True)) != p.raw[which]:
                    continue  # two words of one hash
                edge[at.start] += 1
                edge[at.stop] -= 1
                items[rows[end]].update(p.items[which])
    hit = np.cumsum(edge[:-1]) > 0
    return n_words, np.bincount(rows[hit], minlength=n).astype(np.int64), items


def windows_of(text: str, window: int) -> list[tuple[bytes, ...]]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    folded, starts, ends, _, _ = T.words(data, np.array([0, len(data)]))
    own = [folded[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    if not own:
        return []
    return [tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1))]


def pattern_blocks(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> list:
    """Broadcast tables of all patterns, each of at most ``block`` patterns.

    Items are read one by one, never held together; a pattern that comes again in a later block is searched twice and
    counted once, as hits are marks on words and items are sets.
    """
    sc = benchmark.sparkSession.sparkContext
    out, found = [], {}
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    for row in rows.toLocalIterator():
        for pattern in windows_of(row.text, window):
            found.setdefault(pattern, set()).add(row.item)
            if len(found) >= block:
                out.append(sc.broadcast(compile_patterns(found)))
                found = {}
    if found or not out:
        out.append(sc.broadcast(compile_patterns(found)))
    return out


def occurrences(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """Per row of ``df``: doc_id, n_words, n_hit and the items with a window in its text, sorted as strings.

    Null and empty texts have no words; a null item_id is the empty string; without items nothing is hit; repeated rows
    are judged each; of both tables only key and text are read.
    """
    tables = pattern_blocks(benchmark, window)

    def run(batches):
        for whole in batches:
            for batch in T.portions(whole, "text"):
                n_words, n_hit, items = search([t.value for t in tables], *T.column(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    return docs.texts(df, key).mapInArrow(run, OCCURRENCES)


def clean(df: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``df``, all columns, in whose text no benchmark window occurs."""
    tables = pattern_blocks(benchmark, window)

    def run(batches):
        for whole in batches:
            for batch in T.portions(whole, "text"):
                _, n_hit, _ = search([t.value for t in tables], *T.column(batch.column("text")))
                yield batch.filter(pa.array(n_hit == 0))

    return df.mapInArrow(run, df.schema)


def op2(spark: SparkSession, path: str) -> DataFrame:
    found = occurrences(docs.table(spark, path, "documents"), docs.table(spark, path, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, w[k : k + 9] AS win FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(k) WHERE len(w) > 0),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lengths AS (SELECT DISTINCT len(win) AS m FROM windows),
places AS (SELECT doc_id, k, m, w[k : k + m - 1] AS win FROM doc_words, lengths, unnest(range(1, len(w) - m + 2)) AS u(k) WHERE len(w) >= m),
found AS (SELECT doc_id, k, m, item_id FROM places JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS j FROM found) AS x GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) AS y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words AS d LEFT JOIN hit USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

docs.register("op2_wu_manber", op2, OP2_SQL)
