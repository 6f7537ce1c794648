"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns what the next one reads. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import language_id, mixing, packing, secret_scan, simhash_dedup
from lamina.llm.queries import read, remainder, tokenizer_path
from lamina.session import shared_dir

#: A text is rejected when its words are less sure of their language than this, from 0 (all languages alike) to 1.
LEAST_SURENESS = 2 / 15


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Those without a letter (null and empty ones too), or of words that no language
    claims, go. Long texts are read whole; repeated rows and rows without an id are judged each by itself."""
    field = language_id.fit_languages(docs, remainder(4) != 2)
    return language_id.keep_known(docs, field, LEAST_SURENESS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; null and empty texts are copies of each other.

    Rows that share an id without being copies all stay; of rows without an id one of each group without ids."""
    return simhash_dedup.drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credentials in the whole texts are replaced by their kind; no document goes. Null texts stay null."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources as even as can be with none read more than 1.5 times, each read at least once in full.

    A null source is one source; a null or empty text counts as one token."""
    return mixing.mix(docs, max_repeats=1.5, whole=True).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens; a null or empty text is the end token alone."""
    return packing.pack_documents(docs, tokenizer_path(), added=True)


STAGES = [
    ("language_id", identify),
    ("simhash_dedup", deduplicate),
    ("secret_scan", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither the models nor the tokenizer; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            path = f"{folder}/{number}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
