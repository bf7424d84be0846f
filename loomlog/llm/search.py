"""Ranked lexical search by bag deduplication (operator 13).

A document is restricted to the words of the items: a bag of (term, count). With a document's length number m this is all that a score depends
on, so documents with the same bag and m form a class. Tasks gather their own classes first (a class sends one row per
task, however many copies there are), classes meet by a 64-bit hash and are told apart by comparing bags and m, each is scored once against all
items, and only then are its members listed by ascending doc_id. A class needs as many members as a ranking has
places, so nothing grows with a group of copies.

Items are searched in groups of about ``PAIRS`` (item, term) pairs. Only a group's words, weights and postings are sent to the tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomlog.llm import documents as docs
from loomlog.llm import text as T
from loomlog.plans.stage import staged

PLACES = 10
PAIRS = 1_000_000  # 16 bytes each, through the driver
HELD = 16 << 20  # bytes of bags that a task gathers before it passes them on
CELLS = 1 << 21  # scores, or postings, worked on at once
CLASSES = "key long, m long, bag binary, members array<long>"
_ENTRY = np.dtype([("term", "<u4"), ("tf", "<u4")])


# ---------------------------------------------------------------------------------------------------------------
# Items


def item_terms(items: DataFrame) -> DataFrame:
    """The different (item_id, term) pairs; rows of one item_id are one item, null an id like any other. Terms are word hashes."""

    def run(batches):
        for whole in batches:
            for batch in T.portions(whole, "text"):
                _, _, _, rows, words = T.words(*T.column(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(rows)), pa.array(words.view(np.int64))], names=["item_id", "term"])

    pairs = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return pairs.mapInArrow(run, "item_id long, term long").distinct()


@dataclass
class Items:
    """A group of items: their words sorted by hash, and for each word the items that hold it."""

    ids: list[int | None]
    vocabulary: np.ndarray  # uint64, sorted
    starts: np.ndarray  # of each word in ``holders``
    counts: np.ndarray
    holders: np.ndarray
    most: int  # words of the longest item

    @classmethod
    def of(cls, pairs: pa.Table) -> Items:
        found = pairs.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        number = found.indices.to_numpy()
        vocabulary, word = np.unique(pairs.column("term").to_numpy().view(np.uint64), return_inverse=True)
        counts = np.bincount(word, minlength=len(vocabulary))
        return cls(found.dictionary.to_pylist(), vocabulary, np.cumsum(counts) - counts, counts, number[np.argsort(word, kind="stable")].astype(np.int64), int(np.bincount(number).max()))


# ---------------------------------------------------------------------------------------------------------------
# Documents


def bags(df: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, number of words, and its bag: (term, count) entries of 8 bytes, by term."""
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]):
        known = held.value
        for whole in batches:
            for batch in T.portions(whole, "text"):
                _, _, _, rows, words = T.words(*T.column(batch.column("text")))
                n = np.bincount(rows, minlength=batch.num_rows)
                at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
                ours = known[at] == words if len(known) else np.zeros(len(words), bool)
                keys, tf = np.unique(rows[ours] * max(1, len(known)) + at[ours], return_counts=True)
                entries = np.empty(len(keys), _ENTRY)
                entries["term"], entries["tf"] = keys % max(1, len(known)), tf
                ends = np.append(0, np.cumsum(np.bincount(keys // max(1, len(known)), minlength=batch.num_rows))).astype(np.int32) * 8
                bag = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(entries.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), bag], names=["doc_id", "n", "bag"])

    return docs.texts(df).mapInArrow(run, "doc_id long, n long, bag binary")


def term_documents(found: DataFrame, n_terms: int) -> np.ndarray:
    """Number of documents that hold each term; a task sends one count per term it has met."""

    def count(batches):
        own = np.zeros(n_terms, np.int64)
        for batch in batches:
            own += np.bincount(np.frombuffer(T.column(batch.column("bag"))[0].tobytes(), _ENTRY)["term"], minlength=n_terms)
        met = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(own[met])], names=["term", "df"])

    counted = found.select("bag").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[counted["term"].to_numpy()] = counted["df"].to_numpy()
    return out


def length_numbers(n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m of documents of n words, in whole numbers of any size on the way."""
    different, which = np.unique(n, return_inverse=True)
    return np.array([100 - 90 + 90 * int(x) * n_docs // n_words for x in different], np.int64)[which]


def _order(key: int | None) -> tuple:
    return (key is not None, key or 0)


def classes(found: DataFrame, n_docs: int, n_words: int, places: int = PLACES) -> DataFrame:
    """Per task and class met there: a hash of bag and m, both, and the first ``places`` members by doc_id (nulls first, repeated ids repeated)."""

    def run(batches: Iterator[pa.RecordBatch]):
        own: dict[tuple[bytes, int], list] = {}
        size = 0
        for batch in batches:
            m = length_numbers(np.asarray(batch.column("n")), n_docs, n_words) if batch.num_rows else []
            for bag, number, key in zip(batch.column("bag").to_pylist(), m, batch.column("doc_id").to_pylist(), strict=True):
                if not bag:
                    continue  # no word of any item: no score
                members = own.get((bag, int(number)))
                if members is None:
                    own[bag, int(number)] = [key]
                    size += len(bag) + 200
                else:
                    members.append(key)
                    if len(members) > 20 * places:
                        members[:] = sorted(members, key=_order)[:places]
            if size > HELD:
                yield flush(own)
                own, size = {}, 0
        if own:
            yield flush(own)

    def flush(own: dict) -> pa.RecordBatch:
        keys = [int.from_bytes(hashlib.blake2b(bag, digest_size=8, salt=number.to_bytes(8, "little")).digest(), "little", signed=True) for bag, number in own]
        members = [sorted(x, key=_order)[:places] for x in own.values()]
        columns = [pa.array(keys, pa.int64()), pa.array([k[1] for k in own], pa.int64()), pa.array([k[0] for k in own], pa.binary()), pa.array(members, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "m", "bag", "members"])

    return found.mapInArrow(run, CLASSES)


# ---------------------------------------------------------------------------------------------------------------
# Scoring


class Ranking:
    """The best documents of each item of a group, kept as (item, score, null id, id)."""

    def __init__(self, n_items: int, places: int):
        self.n, self.places = n_items, places
        self.least = np.zeros(n_items, np.int64)  # score of the last place, 0 while there is room
        self.rows = np.zeros((0, 4), np.int64)

    def add(self, scores: np.ndarray, members: list[list]) -> None:
        """Scores of classes x items, and the members of each class."""
        least = np.maximum(self.least, 1)
        if len(scores) > self.places:
            least = np.maximum(least, np.partition(scores, len(scores) - self.places, axis=0)[len(scores) - self.places])
        which, item = np.nonzero(scores >= least)
        sizes = np.array([len(x) for x in members])
        flat = [x for own in members for x in own]
        ids, null = np.array([x or 0 for x in flat], np.int64), np.array([x is None for x in flat])
        at = T.ragged((np.cumsum(sizes) - sizes)[which], sizes[which])
        many = sizes[which]
        more = np.column_stack([np.repeat(item, many), np.repeat(scores[which, item], many), ~null[at], ids[at]]).astype(np.int64)
        rows = np.concatenate([self.rows, more])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        self.rows = rows[place < self.places]
        last = rows[place == self.places - 1]
        self.least[last[:, 0]] = last[:, 1]


def term_values(weights: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def score(items: Items, weights: np.ndarray, bag: list[bytes], m: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of the classes with their scores, classes x items. Sums are exact: they are taken in doubles only where no sum can pass 2**53."""
    entries = np.frombuffer(b"".join(bag), _ENTRY)
    sizes = np.array([len(b) // 8 for b in bag])
    owner = np.repeat(np.arange(len(bag)), sizes)
    value = term_values(weights, entries["term"], entries["tf"], m[owner])
    postings = items.counts[entries["term"]]
    n = len(items.ids)
    work = np.cumsum(np.bincount(owner, weights=postings, minlength=len(bag)) + n)
    small = items.most * int(weights.max(initial=0)) * 1_000_000 < 1 << 53
    i = 0
    while i < len(bag):
        j = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + CELLS, "right")))
        low, high = np.searchsorted(owner, [i, j])
        term, many = entries["term"][low:high], postings[low:high]
        cell = np.repeat((owner[low:high] - i) * n, many) + items.holders[T.ragged(items.starts[term], many)]
        each = np.repeat(value[low:high], many)
        if small:
            out = np.bincount(cell, weights=each, minlength=(j - i) * n).astype(np.int64)
        else:
            out = np.zeros((j - i) * n, np.int64)
            np.add.at(out, cell, each)
        yield slice(i, j), out.reshape(j - i, n)
        i = j


def search(df: DataFrame, items: DataFrame, places: int = PLACES) -> DataFrame:
    """Per item: its ``places`` highest-scoring documents with a score above 0 (item_id, rank from 1, doc_id, score), equal scores by ascending doc_id, nulls first.

    Null and empty texts have no terms: such items give no rows, such documents none and don't count. Rows of one item_id are one item; each row of
    ``df`` is a document of its own, so repeated rows take places of their own. An empty table on either side gives no rows. Only the keys and texts are read.
    """
    spark = df.sparkSession
    pairs = staged(item_terms(items))
    groups = max(1, -(-pairs.count() // PAIRS))
    found = [_search_group(df, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow(), places) for g in range(groups)]
    out = found[0] or spark.createDataFrame([], "item_id long, score long, doc_id long")
    for more in filter(None, found[1:]):
        out = out.unionByName(more)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= places).select("item_id", "rank", "doc_id", "score")


def _search_group(df: DataFrame, pairs: pa.Table, places: int) -> DataFrame | None:
    """Per task that scores classes: the best documents of each item there."""
    if not len(pairs):
        return None
    items = Items.of(pairs)
    found = staged(bags(df, items.vocabulary))
    n_docs, n_words = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_words:
        return None
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in term_documents(found, len(items.vocabulary))], np.int64)
    held = df.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]):
        items, weights = held.value
        best = Ranking(len(items.ids), places)
        waiting: list[list] = []  # m, bag, members
        size = 0

        def rank():
            for part, scores in score(items, weights, [w[1] for w in waiting], np.array([w[0] for w in waiting], np.int64)):
                best.add(scores, [sorted(w[2], key=_order)[:places] for w in waiting[part]])

        for batch in batches:
            for m, bag, members in zip(*(batch.column(k).to_pylist() for k in ("m", "bag", "members")), strict=True):
                if waiting and waiting[-1][0] == m and waiting[-1][1] == bag:  # the same class from another task
                    waiting[-1][2] += members
                    if len(waiting[-1][2]) > 20 * places:
                        waiting[-1][2] = sorted(waiting[-1][2], key=_order)[:places]
                    continue
                if size > HELD // 4:
                    rank()
                    waiting, size = [], 0
                waiting.append([m, bag, members])
                size += len(bag) + 100
        if waiting:
            rank()
        item, points, known, ids = best.rows.T
        columns = [pa.array([items.ids[i] for i in item], pa.int64()), pa.array(points), pa.array(ids, pa.int64(), mask=known == 0)]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "score", "doc_id"])

    met = classes(found, n_docs, n_words, places).repartition("key").sortWithinPartitions("key", "m", "bag")
    return met.drop("key").mapInArrow(run, "item_id long, score long, doc_id long")


def op13(spark: SparkSession, path: str) -> DataFrame:
    return search(docs.table(spark, path, "documents"), docs.table(spark, path, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
doc_words AS (SELECT row_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
bags AS MATERIALIZED (SELECT row_id, term, count(*) AS tf FROM doc_words GROUP BY ALL),
lengths AS MATERIALIZED (SELECT row_id, CAST(sum(tf) AS BIGINT) AS n FROM bags GROUP BY ALL),
totals AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM lengths),
item_terms AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM bags, totals GROUP BY term, n_docs),
scored AS (SELECT item_id, row_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_words))))) AS BIGINT) AS score
  FROM item_terms JOIN weights USING (term) JOIN bags USING (term) JOIN lengths USING (row_id), totals GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS FIRST) AS rank FROM scored JOIN d USING (row_id) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

docs.register("op13_bag_search", op13, OP13_SQL)
