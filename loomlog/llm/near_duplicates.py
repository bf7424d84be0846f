"""N-gram Jaccard join by MinHash banding (operator 4).

Texts become sets of hashes of ``NGRAM`` consecutive words. Texts of one set are one class from the start. Minima under random maps are cut
into bands; the numbers of bands and rows follow from the similarity and the recall asked for. Texts that agree in a band share a bucket,
and candidate pairs are compared on their full sets.

Groups of near copies may be large, so their pairs are never listed. First each text is compared with the pivot of one of its buckets, then
with the pivots of the others. Buckets that still hold several components are compared in tiles of ``TILE`` n-grams, tile against
tile by matrix products, and give no more links than they have texts. Components are final after that: every pair of a
bucket is joined already or was compared. How many links a text has is counted inside its component, by tiles as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import documents as docs
from loomlog.llm import text as T
from loomlog.plans.stage import again, staged

NGRAM = 5
SIMILARITY = 0.8
RECALL = 0.9999
MOST_HASHES = 200
TILE = 1 << 17
TILE_TEXTS = 1024
COMMON = 8
_COLUMNS = 4096
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def banding(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have if pairs at ``similarity`` are to meet with probability ``recall``."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def ngrams(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts in order, and where each text's begin (texts + 1). A shorter text is one n-gram, one without words none."""
    _, _, _, rows, words = T.words(data, offsets)
    texts = len(offsets) - 1
    counts = np.bincount(rows, minlength=texts).astype(np.int64)
    heads = np.cumsum(counts) - counts
    grams = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    at = T.ragged(heads, grams)
    size = np.repeat(np.minimum(counts, n), grams)
    value = size.astype(np.uint64)
    for k in range(n):
        inside = k < size
        word = words[np.minimum(at + k, len(words) - 1)] if len(words) else words
        value = np.where(inside, value * _STEP + word, value)
    return T.mix(value), np.concatenate([[0], np.cumsum(grams)])


def sets(data: np.ndarray, offsets: np.ndarray, n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    values, starts = ngrams(data, offsets, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = np.sort(values[a:b])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out


def set_keys(found: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set; texts without words are told apart by their bytes."""
    keys = np.array([T.mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) if len(s) else 0 for s in found], np.uint64)
    bare = np.flatnonzero([not len(s) for s in found])
    if len(bare):
        keys[bare] = T.span_hashes(data, offsets[bare], offsets[bare + 1]) + np.uint64(1)
    return T.mix(keys).view(np.int64)


def minima(found: list[np.ndarray], hashes: int) -> np.ndarray:
    """Smallest value of each set (none of them empty) under each of the maps x -> a * x + b modulo 2**32."""
    rng = np.random.default_rng(20_011)
    a, b = rng.integers(0, 1 << 31, hashes, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, hashes, np.uint32)
    flat = np.concatenate(found)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *[len(s) for s in found[:-1]]])
    out = np.empty((len(found), hashes), np.uint32)
    mapped = np.empty_like(flat)
    for k in range(hashes):
        np.multiply(flat, a[k], out=mapped)
        mapped += b[k]
        out[:, k] = np.minimum.reduceat(mapped, starts)
    return out


def band_keys(found: list[np.ndarray], bands: int, rows: int) -> list[np.ndarray]:
    """The buckets of each set, a number for each band; none for an empty set."""
    full = [i for i, s in enumerate(found) if len(s)]
    out = [np.zeros(0, np.int64)] * len(found)
    if full:
        least = minima([found[i] for i in full], bands * rows).astype(np.uint64).reshape(len(full), bands, rows)
        value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(full), bands))
        for r in range(rows):
            value = T.mix(value * _STEP + least[:, :, r])
        for i, own in zip(full, value.view(np.int64), strict=True):
            out[i] = own
    return out


# ---------------------------------------------------------------------------------------------------------------
# The join


def _signed(df: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """(doc_id, row, key, size, bands) of each row; ``row`` is a hash of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for batch in T.portions(whole, "text"):
                column = T.column(batch.column("text"))
                found = sets(*column, n)
                keys = set_keys(found, *column)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(keys), pa.array([len(s) for s in found], pa.int64()), pa.array(band_keys(found, bands, rows), pa.list_(pa.int64()))], names=["doc_id", "row", "key", "size", "bands"])

    return df.select("doc_id", "text", _row_hash().alias("row")).mapInArrow(run, "doc_id long, row long, key long, size long, bands array<long>")


def _row_hash():  # noqa: ANN202
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _rows_of(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, asked_key) of the wanted (key, row). Rows are found by their hash, so those without an id, or with one id, don't meet each other."""
    asked = wanted.select(F.col("row").alias("asked"), F.col("key").alias("asked_key"))
    return df.withColumn("own", _row_hash()).join(asked, F.col("own") == F.col("asked")).select("text", "asked_key")


def _sets_of(df: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, grams) of the wanted (key, row), made anew from one text of each."""
    some = _rows_of(df, wanted)

    def run(batches):
        for whole in batches:
            for batch in T.portions(whole, "text"):
                column = T.column(batch.column("text"))
                found = sets(*column, n)
                ours = np.flatnonzero(set_keys(found, *column) == batch.column("asked_key").to_numpy())  # but for two rows of one hash
                yield pa.RecordBatch.from_arrays([batch.column("asked_key").take(pa.array(ours)), pa.array([found[i].tobytes() for i in ours], pa.binary())], names=["key", "grams"])

    return some.mapInArrow(run, "key long, grams binary").groupBy("key").agg(F.first("grams").alias("grams"))


def _compared(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough."""
    left, right = grams.select(F.col("key").alias("a"), F.col("grams").alias("ga")), grams.select(F.col("key").alias("b"), F.col("grams").alias("gb"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ga"), batch.column("gb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(_linked(np.count_nonzero(y[at] == x), len(x), len(y), similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def _linked(common, size_a, size_b, similarity: float):  # noqa: ANN001, ANN202
    return common * (1 + similarity) >= similarity * (size_a + size_b) - 1e-9


def components(links: DataFrame) -> DataFrame:
    """(key, component) of all keys of the links (a, b); a component is named by its smallest key.

    Each round takes the smallest name among the neighbours and then the name of that name, so chains halve.
    """
    edges = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = staged(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("component")).select("key", F.least("key", "component").alias("component")))
    while True:
        near = again(edges).join(again(names).withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("component").alias("near"))
        lower = staged(names.join(near, "key").select("key", F.col("component").alias("was"), F.least("component", "near").alias("component")))
        up = again(lower).select(F.col("key").alias("component"), F.col("component").alias("up"))
        jumped = staged(lower.select("key", "component", "was").join(up, "component").select("key", F.least("component", "up").alias("component"), "was"))
        changed = jumped.where(F.col("component") != F.col("was")).limit(1).count()
        names = jumped
        if not changed:  # staged, with a column of the names before
            return names


def join(df: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, n: int = NGRAM) -> DataFrame:
    """Per row: doc_id, class_id, text_id, n_links, n_texts.

    class_id: smallest doc_id of all texts joined by chains of links; text_id: smallest doc_id of the texts with the same n-grams;
    n_links: other rows at the similarity or above, copies included; n_texts: other sets of n-grams among them. Sets are told apart by
    a 64-bit hash. Null and empty texts have no n-grams; they and other texts without words are alike only if equal byte for byte. Repeated rows are
    copies of each other. Only doc_id and text are read.
    """
    return _joined(df, similarity, recall, n).select("doc_id", "class_id", "text_id", "n_links", "n_texts")


def _joined(df: DataFrame, similarity: float, recall: float, n: int) -> DataFrame:
    df = docs.texts(df)
    bands, rows = banding(similarity, recall)
    signed = staged(_signed(df, bands, rows, n))
    texts = staged(signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    buckets = again(texts).select(F.explode("bands").alias("bucket"), "key", "size")
    shared = staged(buckets.groupBy("bucket").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("bucket", "pivot"))
    members = staged(buckets.join(shared, "bucket").select("bucket", "pivot", "key", "size"))
    asked = members.select("key").distinct().join(again(texts).select("key", "row"), "key")
    grams = staged(_sets_of(df, asked, n))
    # one pivot of each text, then the pivots of other components, then whatever else shares a bucket
    star = members.where("key <> pivot")
    links = staged(_compared(star.groupBy(F.col("key").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b"), grams, similarity))
    named = components(links)

    def with_component(rows: DataFrame, key: str, name: str) -> DataFrame:
        known = again(named).select(F.col("key").alias(key), F.col("component").alias(name))
        return rows.join(known, key, "left").withColumn(name, F.coalesce(name, key))

    apart = with_component(with_component(star.select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    more = staged(_compared(apart.join(links, ["a", "b"], "left_anti"), again(grams), similarity))
    links = staged(links.union(more))
    named = components(links)
    mixed = staged(with_component(members.select("bucket", "key", "size"), "key", "component"))
    several = again(mixed).groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    more = staged(_tiled(mixed.join(several, "bucket"), ["bucket"], again(grams)).applyInArrow(_forest_of(similarity), "a long, b long").distinct())
    named = components(staged(links.union(more)))
    counted = _link_counts(again(named).select("key", "component"), again(texts).select("key", "copies", "size"), again(grams), similarity)
    per_text = staged(again(texts).select("key", "doc_id", "copies").join(again(named).select("key", "component"), "key", "left").join(counted, "key", "left").withColumn("component", F.coalesce("component", "key")))
    classes = again(per_text).groupBy("component").agg(F.min("doc_id").alias("class_id"))
    per_text = per_text.join(classes, "component").select(
        "key", "component", F.col("doc_id").alias("text_id"), "class_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
    )
    return again(signed).select("doc_id", "row", "key").join(per_text, "key")


def _tiled(members: DataFrame, group: list[str], grams: DataFrame):  # noqa: ANN202
    """Members of each group in tiles of about ``TILE`` n-grams and at most some ``TILE_TEXTS`` texts, each tile beside each other one (columns i and j), with their sets."""
    members = staged(members)
    least = F.greatest(F.sum("size") / TILE, F.count("*") / TILE_TEXTS)  # short texts fill a matrix before they fill a tile
    tiles = again(members).groupBy(*group).agg((F.floor(least) + 1).cast("int").alias("tiles"))
    own = members.join(tiles, group).withColumn("tile", F.pmod(F.hash("key"), F.col("tiles")))
    own = own.join(grams, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return own.drop("tiles").withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).groupBy(*group, "i", "j")


def _tile_links(group: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Rows of the two tiles, which of them are linked, and whether both are one tile."""
    tile = group.column("tile").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    held = [np.frombuffer(g.as_py(), np.uint64) for g in group.column("grams")]
    sizes = np.array([len(g) for g in held])
    a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    return a, b, _linked(intersections([held[k] for k in a], [held[k] for k in b]), sizes[a][:, None], sizes[b][None, :], similarity), i == j


def _forest_of(similarity: float):  # noqa: ANN202
    """Links between components within two tiles, as few as keep what is joined together: fewer than there are texts."""

    def run(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        _, root = np.unique(group.column("component").to_numpy(), return_inverse=True)
        a, b, linked, _ = _tile_links(group, similarity)
        out = []
        while True:
            cross = linked & (root[a][:, None] != root[b][None, :])
            rows = np.flatnonzero(cross.any(1))
            if not len(rows):
                break
            for r, c in zip(a[rows], b[cross[rows].argmax(1)], strict=True):
                if root[r] != root[c]:
                    out.append((keys[r], keys[c]))
                    root[root == root[c]] = root[r]
        return pa.table([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _link_counts(named: DataFrame, texts: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(key, n_links, n_texts): linked rows and linked texts of each text of a component.

    A task compares two tiles of a component and sends a number per text.
    """

    def count(group: pa.Table) -> pa.Table:
        keys, copies = group.column("key").to_numpy(), group.column("copies").to_numpy()
        a, b, linked, one = _tile_links(group, similarity)
        if one:
            np.fill_diagonal(linked, False)
        found = [(keys[a], linked @ copies[b], linked.sum(1))]
        if not one:
            found.append((keys[b], linked.T @ copies[a], linked.sum(0)))
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=["key", "n_links", "n_texts"])

    counts = _tiled(named.join(texts, "key"), ["component"], grams).applyInArrow(count, "key long, n_links long, n_texts long")
    return counts.groupBy("key").agg(F.sum("n_links").alias("n_links"), F.sum("n_texts").alias("n_texts"))


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set.

    n-grams that many sets hold are counted by products of 0/1 matrices, some thousand columns at a time; the others pair by pair of their holders.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    grams = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    total = np.diff(np.append(edge, len(grams)))
    of_left = np.add.reduceat((owner < len(left)).astype(np.int64), edge) if len(edge) else total
    of_right = total - of_left
    both = (of_left > 0) & (of_right > 0)
    edge, of_left, of_right = edge[both], of_left[both], of_right[both]
    many = of_left * of_right > COMMON * COMMON
    high = np.flatnonzero(many)
    for k in range(0, len(high), _COLUMNS):
        part = high[k : k + _COLUMNS]
        at = T.ragged(edge[part], (of_left + of_right)[part])
        column = np.repeat(np.arange(len(part)), (of_left + of_right)[part])
        cells = np.zeros((len(left) + len(right), len(part)), np.float32)
        cells[owner[at], column] = 1
        out += cells[: len(left)] @ cells[len(left) :].T
    low = np.flatnonzero(~many)
    for k in range(0, len(low), _COLUMNS):
        part = low[k : k + _COLUMNS]
        a, b = of_left[part], of_right[part]
        first = np.repeat(T.ragged(edge[part], a), np.repeat(b, a))  # owners are sorted, the left ones first
        second = T.ragged(np.repeat(edge[part] + a, a), np.repeat(b, a))
        out += np.bincount(owner[first] * len(right) + owner[second] - len(left), minlength=out.size).reshape(out.shape)
    return out


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of ``df``, all columns, that stand for their class: the one with the smallest doc_id (null ids last, equal ids by a hash of the text).

    Repeated rows with one doc_id and text are one document.
    """
    joined = _joined(df, SIMILARITY, RECALL, NGRAM)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = joined.groupBy("component").agg(first).select(F.col("first.row").alias("row"))
    own = "row"
    while own in df.columns:
        own += "_"
    return df.withColumn(own, _row_hash()).join(kept.withColumnRenamed("row", own), own, "left_semi").dropDuplicates([own]).drop(own)


def op4(spark: SparkSession, path: str) -> DataFrame:
    return join(docs.table(spark, path, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT r, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' ')))) AS s FROM d WHERE len(w) > 0),
e AS (SELECT d.r, doc_id, coalesce(array_to_string(s, '|'), concat('bytes:', text)) AS body, coalesce(len(s), 0) AS size FROM d LEFT JOIN g USING (r)),
t AS (SELECT body, min(r) AS t, min(doc_id) AS text_id, count(*) AS copies, min(size) AS size FROM e GROUP BY body),
u AS (SELECT t, unnest(s) AS gram FROM t JOIN g ON g.r = t.t),
common AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM u AS a JOIN u AS b ON a.gram = b.gram AND a.t <> b.t GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN t AS x ON x.t = a JOIN t AS y ON y.t = b WHERE n * 1.8 >= 0.8 * (x.size + y.size) - 1e-9),
reach AS (SELECT t AS a, t AS b FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT reach.a AS t, min(text_id) AS class_id FROM reach JOIN t ON t.t = reach.b GROUP BY 1),
counts AS (SELECT a AS t, sum(copies) AS n_links, count(*) AS n_texts FROM links JOIN t ON t.t = b GROUP BY 1)
SELECT doc_id, class_id, text_id, CAST(coalesce(n_links, 0) + copies - 1 AS BIGINT) AS n_links, CAST(coalesce(n_texts, 0) AS BIGINT) AS n_texts
FROM e JOIN t USING (body) JOIN classes USING (t) LEFT JOIN counts USING (t)"""

docs.register("op4_jaccard_join", op4, OP4_SQL)
