"""A corpus pipeline over ``documents``: each stage takes what the one before it kept, written as Parquet and read again.

toxicity           drops documents that score one half or more
near duplicates    keeps one document of each class of the n-gram join, the one with the smallest doc_id
decontamination    drops documents in which a window of a benchmark item occurs
personal data      replaces each confirmed match by its kind in brackets; n_chars follows the new text
byte-level BPE     gives the ids of each text and the digest of the bytes that decoding gives

All stages but the last return the columns of ``documents``. Extra columns of the input come along, also such as share a name with
something that a stage computes. A null text counts as an empty one; rows without a doc_id and rows with repeated ids are judged
each by its own text. Without documents every stage gives no rows; without labels or items nothing is dropped for them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import bpe, contamination, near_duplicates, personal_data, toxicity
from loomlog.llm.documents import table
from loomlog.plans.stage import stage_dir


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the stage's own documents."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the ids as binary (4 bytes each, little-endian) and SHA-256 of ids and of decoded bytes."""
    coded = bpe.encode_and_verify(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", not_toxic),
    ("near_duplicates", no_near_duplicates),
    ("decontamination", no_benchmark),
    ("personal_data", no_personal_data),
    ("byte_bpe", tokens),
]

# Toxicity is a trained model, so no SQL gives the rows; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{stage_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
