"""Byte-level BPE encoding and decoding with tiktoken and a local rank file (operator 10).

The library splits a text by its pattern and merges the bytes of each match. Long texts are handed over in
pieces: a cut lies before a blank that has a visible character on either side. No match of the pattern can hold
such a blank anywhere but at its start, so the pieces give the very same matches. Decoding joins raw bytes; characters
are never decoded piece by piece.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from loomlog.llm import documents as docs
from loomlog.llm import text as T

PIECE = 1 << 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_encodings: dict[tuple[str, str], object] = {}


def ranks_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoding(path: str, pattern: str = public_tokenizers.PATTERN):
    """The encoding of a rank file, read once in each process."""
    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        _encodings[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at safe places, each piece about ``size`` characters; longer where there is no safe place."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size - 1)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def encode(text: str, path: str, size: int = PIECE) -> np.ndarray:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    own = encoding(path)
    parts = [np.array(own.encode_ordinary(piece), dtype="<u4") for piece in pieces(text, size)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(ids: np.ndarray, path: str, step: int = PIECE) -> bytes:
    """The bytes of ids, however they fall on characters."""
    own = encoding(path)
    return b"".join(own.decode_bytes(ids[i : i + step].tolist()) for i in range(0, len(ids), step))


def encode_column(df: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``df`` and the ids of its texts as binary (4 bytes each, little-endian), in place of a column of that name. Null texts give no ids."""
    path = path or ranks_path()
    return _with(df, text, {out: pa.binary()}, lambda values: [[encode(v or "", path).tobytes() for v in values]])


def decode_column(df: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and the decoded bytes of its ids, in place of a column of that name. Null ids give no bytes."""
    path = path or ranks_path()
    return _with(df, ids, {out: pa.binary()}, lambda values: [[decode(np.frombuffer(v or b"", "<u4"), path) for v in values]])


def encode_and_verify(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """All columns of ``df`` with n_tokens, ids (binary), ids_sha256 and decoded_sha256 in place of columns of these names. Decoded bytes are hashed where they are made and go nowhere."""
    path = path or ranks_path()

    def run(values: list[str | None]) -> list[list]:
        rows = []
        for value in values:
            ids = encode(value or "", path)
            raw = ids.tobytes()
            rows.append((len(ids), raw, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()))
        return list(zip(*rows, strict=True))

    return _with(df, text, {"n_tokens": pa.int64(), "ids": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, run)


def _with(df: DataFrame, source: str, new: dict[str, pa.DataType], run) -> DataFrame:  # noqa: ANN001
    """``df`` with columns computed from one of its columns, by portions of 1 MB of it."""
    kept = [c for c in df.columns if c not in new]
    schema = StructType([*(df.schema[c] for c in kept), *(StructField(name, from_arrow_type(kind)) for name, kind in new.items())])

    def portions(batches):
        for whole in batches:
            for batch in T.portions(whole, source):
                made = run(batch.column(source).to_pylist()) if batch.num_rows else [[] for _ in new]
                columns = [batch.column(c) for c in kept] + [pa.array(v, kind) for v, kind in zip(made, new.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return df.mapInArrow(portions, schema)


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: number of ids, SHA-256 of the ids and of the bytes that decoding them gives.

    Null and empty texts have no ids and the digests of nothing; rows keep their multiplicity; only doc_id and text are read.
    """
    path = path or ranks_path()

    def run(batches):
        for whole in batches:
            for batch in T.portions(whole, "text"):
                counts, coded, raw = [], [], []
                for value in batch.column("text"):
                    ids = encode(value.as_py(), path)
                    counts.append(len(ids))
                    coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    raw.append(hashlib.sha256(decode(ids, path)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.texts(df).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10(spark: SparkSession, path: str) -> DataFrame:
    return digests(docs.table(spark, path, "documents"))


docs.register("op10_byte_bpe", op10)
