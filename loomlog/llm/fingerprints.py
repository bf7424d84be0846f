"""Document fingerprints from prefix polynomial hashes (operator 1).

``PrefixHash`` keeps the sums of c[j] * B**j over each prefix, modulo the prime 2**31 - 1, for two bases. The difference of two
sums is the hash of a span, so any two spans are compared in constant time, and the longest common extension of two
positions is found by binary search over its length.

A fingerprint is a string: number of code points, hash of the whole text (both bases), and the ``SKETCH`` smallest
hashes of all spans of ``SPAN`` code points (a shorter text is one span). Equal texts have equal fingerprints. The likeness
of two fingerprints estimates the Jaccard similarity of their span sets.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from loomlog.llm import documents as docs
from loomlog.plans.stage import staged

PRIME = (1 << 31) - 1
BASES = (1_000_003_019, 1_610_612_741, pow(1_000_003_019, -1, PRIME))  # the third undoes the first
SPAN = 16
SKETCH = 64
BUCKET_CHARS = 8 << 20
_P = np.uint64(PRIME)
_S31 = np.uint64(31)
_STEP = 1 << 16


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1: the high bits are folded onto the low ones."""
    x = (x & _P) + (x >> _S31)
    x = (x & _P) + (x >> _S31)
    return np.where(x >= _P, x - _P, x)


class _Powers:
    known = [np.ones(1, np.uint64)] * 3

    @classmethod
    def of(cls, base: int, n: int) -> np.ndarray:
        have = cls.known[base]
        while len(have) < n:
            more = _mod(have * np.uint64(pow(BASES[base], len(have), PRIME)))
            have = np.concatenate([have, more])
        cls.known[base] = have
        return have


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Modular prefix arrays of one text."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = []
        for b in (0, 1):
            power = _Powers.of(b, self.n + 1)
            own = np.zeros(self.n + 1, np.uint32)
            carry = np.uint64(0)
            for i in range(0, self.n, _STEP):
                part = (points[i : i + _STEP].astype(np.uint64) + np.uint64(1)) * power[i : i + _STEP][: self.n - i]
                run = _mod(np.cumsum(_mod(part)) + carry)
                own[i + 1 : i + 1 + len(run)] = run
                carry = run[-1]
            self.sums.append(own)

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether the spans of ``length`` from i here and from j there are equal."""
        if not (0 <= i <= self.n - length and 0 <= j <= other.n - length):
            return False
        for b in (0, 1):
            power = _Powers.of(b, max(i, j) + 1)
            here = (int(self.sums[b][i + length]) - int(self.sums[b][i])) % PRIME
            there = (int(other.sums[b][j + length]) - int(other.sums[b][j])) % PRIME
            if here * int(power[j]) % PRIME != there * int(power[i]) % PRIME:
                return False
        return True

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(i, other, j, middle) else (low, middle - 1)
        return low

    def whole(self) -> str:
        return f"{int(self.sums[0][-1]):08x}{int(self.sums[1][-1]):08x}"

    def sketch(self) -> np.ndarray:
        """The smallest mixed hashes of all spans, ascending and distinct."""
        width = min(SPAN, self.n)
        least = np.zeros(0, np.uint32)
        if not width:
            return least
        total = self.n - width + 1
        lower = _Powers.of(2, total)
        for i in range(0, total, _STEP):
            k = min(_STEP, total - i)
            low, high = self.sums[0][i : i + k].astype(np.uint64), self.sums[0][i + width : i + width + k].astype(np.uint64)
            mixed = _mix32(_mod((high + _P - low) * lower[i : i + k]).astype(np.uint32))  # every span brought to power 0
            if len(least) == SKETCH:
                mixed = mixed[mixed < least[-1]]
            merged = np.sort(np.concatenate([least, mixed]))
            least = merged[np.concatenate([[True], merged[1:] != merged[:-1]])][:SKETCH]
        return least


def _mix32(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def render(own: PrefixHash, sketch: np.ndarray) -> str:
    return f"{own.n:x}.{own.whole()}.{base64.b64encode(sketch.astype('<u4').tobytes()).decode()}"


def fingerprint(text: str) -> str:
    own = PrefixHash(code_points(text or ""))
    return render(own, own.sketch())


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints. Two empty texts are alike, an empty and any other are not."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(base64.b64decode(f.rsplit(".", 1)[1]), "<u4") for f in (a, b))
    return _alike(x, y)


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    both = np.union1d(x, y)
    # a sketch that is not full holds all spans; beyond the last of a full one nothing is known
    if len(x) >= SKETCH or len(y) >= SKETCH:
        both = both[:SKETCH]
    if not len(both):
        return 1.0
    shared = np.intersect1d(x, y, assume_unique=True)
    return float(np.count_nonzero(shared <= both[-1])) / len(both)


def edited(own: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


# ---------------------------------------------------------------------------------------------------------------
# Each document beside the next one


def ranges(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the bucket they fall in when ids descend, and the table (bucket, next bucket's first row).

    Buckets are id ranges of about ``BUCKET_CHARS`` characters, so only a few numbers per bucket reach the driver.
    """
    sums = df.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(1, min(int(sums[0] or 0), int((sums[1] or 0) // BUCKET_CHARS) + 1))
    cuts = []
    if n > 1:
        found = df.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] or []
        cuts = sorted(set(found))

    @F.pandas_udf("int")
    def bucket(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        at = np.searchsorted(np.array(cuts, np.int64), ids.fillna(0).astype("int64").to_numpy(), "left")
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, len(cuts) - at)).astype("int32")

    rows = df.select("doc_id", "text", F.xxhash64("text").alias("tie"), bucket("doc_id").alias("bucket"))
    return rows, _heads(rows)


def _order():
    """doc_id descending, nulls last, then a hash of the text; rows equal in both are equal."""
    return F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "tie")


def _heads(rows: DataFrame) -> DataFrame:
    heads = [r for r in rows.groupBy("bucket").agg(F.max(_order()).alias("head")).orderBy("bucket").toLocalIterator()]
    pairs = [(heads[i].bucket, heads[(i + 1) % len(heads)]["head"]) for i in range(len(heads))]
    schema = t.StructType([t.StructField("into", t.IntegerType()), t.StructField("doc_id", t.LongType()), t.StructField("tie", t.LongType())])
    return rows.sparkSession.createDataFrame([(b, h.doc_id, h.tie) for b, h in pairs], schema)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def fingerprints(df: DataFrame) -> DataFrame:
    """Per row: fingerprint of the text and of its edited form, and the likeness to that and to the next document.

    "Next" goes by descending doc_id (null ids last, equal ids by a hash of the text, equal rows in any order), after
    the last comes the first; the only row is its own next. Null texts are empty: fingerprint of no spans, edited to
    nothing. ``common_prefix`` is the longest common extension of text and edited text from their starts.
    Only doc_id and text are read.
    """
    rows, heads = ranges(docs.texts(df))
    # the first row of the next range is copied to the end of each range, to be seen but not judged
    copies = rows.join(F.broadcast(heads.withColumnRenamed("doc_id", "head_id").withColumnRenamed("tie", "head_tie")), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie")))
    copies = copies.groupBy("into").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
    copies = staged(copies)
    marked = rows.withColumn("last", F.lit(False)).unionByName(copies.select("doc_id", "text", "tie", F.col("into").alias("bucket"), F.lit(True).alias("last")))
    n = max(1, heads.count())
    dealt = marked.repartition(n, "bucket").sortWithinPartitions("bucket", "last", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    return dealt.select("bucket", "last", "doc_id", "text").mapInArrow(_judge, RESULT)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted rows; each text's arrays are made once and serve it and the row before it."""
    before = None  # bucket, id, text, arrays, sketch
    for batch in batches:
        out = []
        for bucket, last, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if before is not None and before[0] == bucket and before[2] == text:
                own, sketch = before[3:]
            else:
                own = PrefixHash(code_points(text))
                sketch = own.sketch()
            if before is not None and before[0] == bucket:
                out.append(_result(before, text, sketch))
            before = None if last else (bucket, doc_id, text, own, sketch)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(_KINDS)], names=_NAMES)


_NAMES = [part.split()[0] for part in RESULT.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[part.split()[1]] for part in RESULT.split(", ")]


def _result(row: tuple, following: str, next_sketch: np.ndarray) -> tuple:
    _, doc_id, text, own, sketch = row
    changed = edited(text, following)
    other = PrefixHash(code_points(changed))
    other_sketch = other.sketch()
    return (
        doc_id, own.n, hashlib.sha256(changed.encode()).hexdigest(), render(own, sketch), render(other, other_sketch),
        1.0 if changed == text else _alike(sketch, other_sketch), 1.0 if following == text else _alike(sketch, next_sketch),
        own.common_extension(0, other, 0),
    )


def op1(spark: SparkSession, path: str) -> DataFrame:
    return fingerprints(docs.table(spark, path, "documents"))


docs.register("op1_fingerprints", op1)
