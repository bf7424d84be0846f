"""Toxicity by the nearest labelled examples under exact TF-IDF cosine (operator 9).

Terms are words and their first four and five bytes. All terms of a bounded sample of labelled rows (``EXAMPLES``, those with the smallest hash
of their key) form the vocabulary; document frequencies of these terms are counted over all documents. A term that tells the labels apart
(chi-squared) weighs more, none is left out. The examples are indexed term by term in blocks of ``PER_BLOCK``, with the largest
weight of each term in each block; like examples share blocks, and postings of the ``COMMON`` most frequent terms are kept with their gaps. A text meets the postings of the block of its highest upper bound first, then of those whose bound
reaches its k-th best example; what is skipped cannot be among the nearest. The nearest vote with their cosines,
and a logistic curve, fitted on the examples with each one left out, turns the votes into probabilities; with fewer than
``LEAST`` examples of either label, or votes that don't rise with it, the votes stand as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import documents as docs
from loomlog.llm import text as T
from loomlog.plans.stage import staged

EXAMPLES = 4000
CHI2 = 10.83  # one in a thousand; so much chi-squared doubles the weight of a term
NEIGHBOURS = 15
PRIOR_WEIGHT = 0.5
PER_BLOCK = 128
UNKNOWN = 0.49  # without any evidence no text is called toxic
PREFIXES = (4, 5)
ROWS = 256
LEAST = 5
COMMON = 2000
_SLACK = 1e-4


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of all terms of all texts."""
    folded, starts, ends, rows, words = T.words(data, offsets)
    hashes, owners = [words], [rows]
    for k in PREFIXES:
        long = ends - starts > k
        hashes.append(T.span_hashes(folded, starts[long], starts[long] + k) + np.uint64(k))
        owners.append(rows[long])
    return np.concatenate(hashes), np.concatenate(owners)


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.diff(np.append(edge, len(keys)))


def known_terms(vocabulary: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and frequency of the terms of the (sorted) vocabulary in each text; per text, the sum of (1 + log frequency) squared of its other terms."""
    hashes, rows = terms(data, offsets)
    n = len(offsets) - 1
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    ours = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
    keys, tf = _counts(rows[ours].astype(np.int64) * max(1, len(vocabulary)) + at[ours])
    others, times = _counts(rows[~ours].astype(np.uint64) << np.uint64(40) | hashes[~ours] >> np.uint64(24))  # 40 bits tell the terms of a text apart
    rest = np.bincount((others >> np.uint64(40)).astype(np.int64), (1 + np.log(times)) ** 2, n)
    return keys // max(1, len(vocabulary)), keys % max(1, len(vocabulary)), tf, rest


@dataclass
class Query:
    """Texts as TF-IDF rows of unit length (or of nothing): row, term number and weight of each entry, by row."""

    rows: np.ndarray
    numbers: np.ndarray
    values: np.ndarray
    n: int


@dataclass
class Index:
    """Block-max inverted index of the examples, with what scoring needs besides."""

    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray  # with the weight by chi-squared
    unknown: float  # idf of a term that no example holds: the mean of those that one example holds
    runs_of: np.ndarray  # where the runs of each term start, and the end; a run is a term's postings in one block
    run_block: np.ndarray
    run_most: np.ndarray  # the largest weight of the run
    run_starts: np.ndarray  # in the postings, and the end
    example: np.ndarray  # postings, by term and example
    weight: np.ndarray
    common: np.ndarray  # row of a common term in ``full``, -1 for others, whose postings are in runs
    full: np.ndarray  # common terms x blocks x examples of the block
    full_most: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    @property
    def whole(self) -> np.ndarray:
        """Terms x examples, for tests on small tables."""
        out = np.zeros((len(self.vocabulary), len(self.labels)), np.float32)
        run = np.repeat(np.arange(len(self.run_block)), np.diff(self.run_starts))
        out[np.repeat(np.arange(len(self.vocabulary)), np.diff(self.runs_of))[run], self.example] = self.weight
        out[self.common >= 0] = self.full[self.common[self.common >= 0]].reshape(-1, self.full[0].size if len(self.full) else 0)[:, : len(self.labels)]
        return out

    def weights(self, rows: np.ndarray, numbers: np.ndarray, tf: np.ndarray, n: int, rest: np.ndarray | None = None) -> Query:
        """Unit rows; ``rest`` is the share that terms unknown to the index have in each text's norm."""
        values = (1 + np.log(tf)) * self.idf[numbers]
        squares = np.bincount(rows, values * values, n)
        norms = np.sqrt(squares if rest is None else squares + self.unknown**2 * rest)
        return Query(rows, numbers, (values / norms[rows]).astype(np.float32), n)

    def nearest(self, q: Query | np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the k nearest examples of each row, ties by number; ``skip`` is an example to leave out per row."""
        if isinstance(q, np.ndarray):
            rows, numbers = np.nonzero(q)
            q = Query(rows, numbers, q[rows, numbers], len(q))
        size = len(self.labels)
        k = min(k, size)
        best = np.zeros((q.n, k), np.float32)
        who = np.full((q.n, k), size, np.int64)
        edges = np.searchsorted(q.rows, np.arange(q.n + 1))
        step = 64  # texts whose common terms are multiplied at once
        for r in range(q.n if size else 0):
            own = slice(edges[r], edges[r + 1])
            if r % step == 0:
                some = slice(edges[r], edges[min(r + step, q.n)])
                row = self.common[q.numbers[some]]
                of_common = np.zeros((min(step, q.n - r), len(self.full)), np.float32)
                of_common[q.rows[some][row >= 0] - r, row[row >= 0]] = q.values[some][row >= 0]
                dense = of_common @ self.full.reshape(len(self.full), self.full.shape[1] * PER_BLOCK)
            found = self._cosines(q.numbers[own], q.values[own], dense[r % step], k, None if skip is None else int(skip[r]))
            least = np.partition(found, size - k)[size - k]
            near = np.flatnonzero(found >= least)
            near = near[np.lexsort((near, -found[near]))[:k]]
            best[r], who[r] = np.maximum(found[near], 0), near
        return best, who

    def _cosines(self, numbers: np.ndarray, values: np.ndarray, dense: np.ndarray, k: int, skip: int | None) -> np.ndarray:
        """Cosine of a text to each example that can be among its ``k`` nearest, 0 for others and -1 for the one to skip.
        ``dense``: what the common terms give to each example."""
        size, n_blocks = len(self.labels), self.full.shape[1]
        dense = dense.reshape(n_blocks, PER_BLOCK)
        row = self.common[numbers]
        often, strength = row[row >= 0], values[row >= 0]
        numbers, values = numbers[row < 0], values[row < 0]
        many = self.runs_of[numbers + 1] - self.runs_of[numbers]
        runs, share = T.ragged(self.runs_of[numbers], many), np.repeat(values, many)
        blocks = self.run_block[runs]
        bounds = np.bincount(blocks, share * self.run_most[runs], n_blocks) + strength @ self.full_most[often] + _SLACK
        out = np.zeros((n_blocks, PER_BLOCK))

        def meet(which: np.ndarray, some: np.ndarray) -> None:
            starts = self.run_starts[runs[some]]
            counts = self.run_starts[runs[some] + 1] - starts
            at = T.ragged(starts, counts)
            out.reshape(-1)[:] += np.bincount(self.example[at], self.weight[at] * np.repeat(share[some], counts), out.size)
            out[which] += dense[which]

        first = int(bounds.argmax())
        meet(np.array([first]), np.flatnonzero(blocks == first))
        met = out[first, : size - first * PER_BLOCK]
        if skip is not None and skip // PER_BLOCK == first:
            met = np.delete(met, skip - first * PER_BLOCK)
        need = bounds >= (np.partition(met, len(met) - k)[len(met) - k] if len(met) >= k else 0)
        need[first] = False
        meet(np.flatnonzero(need), np.flatnonzero(need[blocks]))
        out = out.reshape(-1)[:size]
        if skip is not None:
            out[skip] = -1
        return out.astype(np.float32)

    def votes(self, cosines: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Share of the toxic among the neighbours, by cosine, drawn to the prior where all are far."""
        found = np.append(self.labels, 0)[who]
        weight = PRIOR_WEIGHT * (2 - who.shape[1] / NEIGHBOURS)  # places that no example fills count for the prior
        return ((cosines * found).sum(1) + weight * self.prior) / (cosines.sum(1) + weight)

    def calibrate(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(votes) + self.shift, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _logistic_fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with targets drawn in by the class sizes so that separated classes stay finite. Where there is nothing to fit: as it is."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if min(n1, n0) < LEAST:
        return 1.0, 0.0
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - target) + 1e-3 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return (float(w[0]), float(w[1])) if w[0] > 1e-3 else (1.0, 0.0)


def _chi_squared(df: np.ndarray, toxic: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Chi-squared of the terms against the labels, from the examples and the toxic examples that hold them; 0 where either has no two sides."""
    b, c = df - toxic, n1 - toxic
    d = n - n1 - b
    below = df * (c + d) * float(n1) * float(n - n1)
    return np.where(below > 0, n * (toxic * d - b * c) ** 2 / np.where(below > 0, below, 1), 0.0)


def build(vocabulary: np.ndarray, frequencies: np.ndarray, n_docs: int, examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Index:
    """The index of examples (id, label, term numbers, frequencies), neighbours in weight side by side so that bounds are tight."""
    idf = np.log((1 + n_docs) / (1 + frequencies)) + 1
    prior = (sum(e[1] for e in examples) + 0.5) / (len(examples) + 2 * LEAST)  # clean without other evidence
    none = np.zeros(0, np.int32)
    index = Index(vocabulary, idf, float(idf.max(initial=1)), np.zeros(len(vocabulary) + 1, np.int64), none, none, np.zeros(1, np.int64), none, none, none, np.zeros((0, 0, PER_BLOCK), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros(0, np.int64), prior)
    if not examples:
        return index
    labels = np.array([e[1] for e in examples])
    sizes = np.array([len(e[2]) for e in examples])
    numbers = np.concatenate([e[2] for e in examples]).astype(np.int64)
    df, toxic = (np.bincount(x, minlength=len(vocabulary)).astype(np.float64) for x in (numbers, numbers[np.repeat(labels, sizes) == 1]))
    index.idf = idf = idf * (1 + _chi_squared(df, toxic, len(examples), int(labels.sum())) / CHI2)
    if (df == 1).any():
        index.unknown = float(idf[df == 1].mean())
    group = _groups(index.weights(np.repeat(np.arange(len(examples)), sizes), numbers, np.concatenate([e[3] for e in examples]), len(examples)), len(vocabulary))
    examples = [examples[i] for i in sorted(range(len(examples)), key=lambda i: (group[i], examples[i][1], i))]
    index.labels, index.ids = np.array([e[1] for e in examples]), np.array([e[0] for e in examples], np.int64)
    rows = np.repeat(np.arange(len(examples)), [len(e[2]) for e in examples])
    w = index.weights(rows, np.concatenate([e[2] for e in examples]).astype(np.int64), np.concatenate([e[3] for e in examples]), len(examples))
    n_blocks = -(-len(examples) // PER_BLOCK)
    frequent = np.sort(np.lexsort((np.arange(len(df)), -df))[:COMMON])
    index.common = np.full(len(vocabulary), -1, np.int32)
    index.common[frequent] = np.arange(len(frequent))
    index.full = np.zeros((len(frequent), n_blocks, PER_BLOCK), np.float32)
    row = index.common[w.numbers]
    index.full.reshape(len(frequent), -1)[row[row >= 0], w.rows[row >= 0]] = w.values[row >= 0]
    index.full_most = index.full.max(2) if len(frequent) else np.zeros((0, n_blocks), np.float32)
    by_term = np.lexsort((w.rows, w.numbers))
    by_term = by_term[row[by_term] < 0]
    number, index.example, index.weight = w.numbers[by_term], w.rows[by_term].astype(np.int64), w.values[by_term].astype(np.float64)
    block = index.example // PER_BLOCK
    fresh = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (block[1:] != block[:-1]))) if len(number) else none
    index.run_block, index.run_starts = block[fresh], np.append(fresh, len(number)).astype(np.int64)
    index.run_most = np.maximum.reduceat(index.weight, fresh) if len(fresh) else index.weight
    index.runs_of = np.searchsorted(number[fresh], np.arange(len(vocabulary) + 1))
    left_out = []
    for i in range(0, len(examples), ROWS):
        low, high = np.searchsorted(w.rows, [i, i + ROWS])
        n = min(ROWS, len(examples) - i)
        left_out.append(index.votes(*index.nearest(Query(w.rows[low:high] - i, w.numbers[low:high], w.values[low:high], n), NEIGHBOURS, np.arange(i, i + n))))
    index.slope, index.shift = _logistic_fit(_logit(np.concatenate(left_out)), index.labels)
    return index


def _groups(w: Query, n_terms: int, rounds: int = 4) -> np.ndarray:
    """A group of like examples for each, half as many groups as blocks, by spherical k-means. It decides who shares a block, not what scores are."""
    k = max(1, w.n // PER_BLOCK // 2)
    group = np.arange(w.n) * k // max(1, w.n)
    for _ in range(rounds if k > 1 else 0):
        likeness = np.empty((k, w.n))
        for g in range(k):
            own = group[w.rows] == g
            centre = np.bincount(w.numbers[own], w.values[own], n_terms)
            centre /= max(np.sqrt(centre @ centre), 1e-9)
            likeness[g] = np.bincount(w.rows, w.values * centre[w.numbers], w.n)
        group = likeness.argmax(0)
    return group


# ---------------------------------------------------------------------------------------------------------------
# Fitting and scoring over tables


def fit(df: DataFrame, labels: DataFrame, held_out: int | None = 0, modulus: int = 5, examples: int = EXAMPLES, n_terms: int | None = None) -> Index:
    """An index from rows of ``labels`` (doc_id, toxic), but for those whose crc32 leaves ``held_out`` modulo ``modulus``.

    Null labels and keys are passed over; the largest label counts where a key has several. Bounded: ``examples`` rows.
    All their terms are indexed, or with ``n_terms`` so many of the largest chi-squared.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        known = known.where(docs.remainder("doc_id", modulus) != held_out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples))
    texts = docs.texts(df)
    # the chosen keys (12 bytes each, ``examples`` of them) go to the documents, not the documents to them
    sample = staged(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))

    def of_sample(batches):
        for whole in batches:
            for batch in T.portions(whole, "text"):
                hashes, rows = terms(*T.column(batch.column("text")))
                found = [_counts(hashes[rows == i]) for i in range(batch.num_rows)]
                both = [pa.array([f[k].astype(kind).tobytes() for f in found], pa.binary()) for k, kind in enumerate((np.uint64, np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *both], names=["doc_id", "toxic", "terms", "tf"])

    rows = sample.select("doc_id", "toxic", "text").mapInArrow(of_sample, "doc_id long, toxic int, terms binary, tf binary").collect()
    found = [(r.doc_id, int(r.toxic > 0), np.frombuffer(r.terms, np.uint64), np.frombuffer(r.tf, np.int32)) for r in sorted(rows, key=lambda r: r.doc_id)]
    vocabulary = np.unique(np.concatenate([f[2] for f in found])) if found else np.zeros(0, np.uint64)
    if n_terms is not None and len(vocabulary) > n_terms:
        df_, toxic = (np.bincount(np.searchsorted(vocabulary, np.concatenate([f[2] for f in found if f[1] >= least] or [vocabulary[:0]])), minlength=len(vocabulary)) for least in (0, 1))
        chi = _chi_squared(df_.astype(np.float64), toxic.astype(np.float64), len(found), sum(f[1] for f in found))
        vocabulary = np.sort(vocabulary[np.argsort(-chi, kind="stable")[:n_terms]])
        found = [(i, y, own[kept], tf[kept]) for i, y, own, tf in found for kept in [np.isin(own, vocabulary)]]
    found = [(i, y, np.searchsorted(vocabulary, own), tf) for i, y, own, tf in found]
    n_docs, frequencies = _document_frequencies(texts, vocabulary)
    return build(vocabulary, frequencies, n_docs, found)


def _document_frequencies(texts: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each term; a task sends one count per term it has met."""

    def count(batches):
        own, n = np.zeros(len(vocabulary), np.int64), 0
        for whole in batches:
            for batch in T.portions(whole, "text"):
                _, numbers, _, _ = known_terms(vocabulary, *T.column(batch.column("text")))
                own += np.bincount(numbers, minlength=len(vocabulary))
                n += batch.num_rows
        seen = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(own[seen], n))], names=["number", "df"])

    counted = texts.select("text").mapInArrow(count, "number long, df long").groupBy("number").agg(F.sum("df").alias("df")).toArrow()
    numbers, df_ = counted["number"].to_numpy(), counted["df"].to_numpy()
    frequencies = np.zeros(len(vocabulary))
    frequencies[numbers[numbers >= 0]] = df_[numbers >= 0]
    return int(df_[numbers < 0].sum()), frequencies


def scores(df: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """Per row: doc_id, score, and the ``evidence`` nearest examples as ``id:cosine:label``, comma-joined.

    Null and empty texts, and texts that share no term with any example, get the score of the prior, ``UNKNOWN`` at most, and no evidence. Equal texts score alike.
    """
    held = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for some in T.portions(whole, "text"):
                for i in range(0, some.num_rows, ROWS):
                    batch = some.slice(i, ROWS)
                    score, shown = judge(held.value, *T.column(batch.column("text")), evidence)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(shown, pa.string())], names=["doc_id", "score", "evidence"])

    return docs.texts(df).mapInArrow(run, "doc_id long, score double, evidence string")


def judge(index: Index, data: np.ndarray, offsets: np.ndarray, evidence: int = 0) -> tuple[np.ndarray, list[str]]:
    n = len(offsets) - 1
    rows, numbers, tf, rest = known_terms(index.vocabulary, data, offsets)
    q = index.weights(rows, numbers, tf, n, rest)
    cosines, who = index.nearest(q, NEIGHBOURS)
    shown = [",".join(f"{index.ids[w]}:{c:.4f}:{index.labels[w]}" for c, w in zip(cosines[i, :evidence], who[i, :evidence], strict=True) if c > 0) for i in range(n)]
    score = index.calibrate(index.votes(cosines, who)).astype(np.float64)
    return np.where(cosines.sum(1) > 0, score, np.minimum(score, UNKNOWN)), shown


def clean(df: DataFrame, index: Index) -> DataFrame:
    """The rows of ``df``, all columns, that score below one half."""
    held = df.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for whole in batches:
            for some in T.portions(whole, "text"):
                for i in range(0, some.num_rows, ROWS):
                    batch = some.slice(i, ROWS)
                    yield batch.filter(pa.array(judge(held.value, *T.column(batch.column("text")))[0] < 0.5))

    return df.mapInArrow(run, df.schema)


def op9(spark: SparkSession, path: str) -> DataFrame:
    documents = docs.table(spark, path, "documents")
    scored = scores(documents, fit(documents, docs.table(spark, path, "labels")))
    return scored.select("doc_id", (docs.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


docs.register("op9_toxicity", op9)
