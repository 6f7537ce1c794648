"""Drawing the documents that look most like a target corpus, by importance weights with noise.

Words (or runs of up to a few) are hashed into buckets. A bucket gains the logarithm of how much more
often it occurs in the target than in the corpus; a document weighs the mean gain of its features, looked
up in one array. Gumbel noise from a hash of the id makes the highest scores a draw without
replacement. A radix sort ranks the scores: the texts are read twice and never shuffled.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.batches import cut
from lamina.llm.radix_sort import radix_rank
from lamina.llm.terms import utf8, words_of
from lamina.session import durable

#: A task remembers the buckets of this many different features.
REMEMBERED = 200_000


def features_of(words: list[bytes], most: int) -> list[bytes]:
    """All runs of 1 to ``most`` consecutive words, joined by a space."""
    found = list(words)
    for n in range(2, most + 1):
        found += [b" ".join(words[at:at + n]) for at in range(len(words) - n + 1)]
    return found


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, most: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in cut(whole, 0):
                seen: Counter = Counter()
                for text in batch.column(0).to_pylist():
                    seen.update(features_of(words_of(text), most))
                for feature, n in seen.items():
                    counts[zlib.crc32(feature) % buckets] += n
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    parts = texts.select(utf8(F.col(text_col))).mapInArrow(count, "bucket long, n long")
    counts = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target share over corpus share, each bucket counted once more than seen."""
    buckets = len(corpus)
    all_corpus, all_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * all_corpus / ((float(s) + 1) * all_target)))
                     for s, t in zip(corpus, target, strict=True)], np.int64)


class _Gains(dict):
    """Gain of a feature, remembered."""

    def __init__(self, gains: list[int]):
        self.gains = gains

    def __missing__(self, feature: bytes) -> int:
        gain = self.gains[zlib.crc32(feature) % len(self.gains)]
        if len(self) < REMEMBERED:
            self[feature] = gain
        return gain


def noise(key: str, seed: str) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a hash."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(
    docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = 1, seed: str = "2024",
) -> DataFrame:
    """``id, n_words, n_features, weight, score`` of each row. See ``resample``."""
    kind = docs.schema[id_col].dataType.simpleString()
    table = [int(g) for g in gains]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = _Gains(table).__getitem__
        for whole in batches:
            for batch in cut(whole, 2):
                n_words, n_features, weights, scores = [], [], [], []
                for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    words = words_of(text)
                    features = features_of(words, most) if most > 1 else words
                    weight = sum(map(gain, features)) // len(features) if features else 0
                    n_words.append(len(words))
                    n_features.append(len(features))
                    weights.append(weight)
                    scores.append(weight + noise(key, seed))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weights, scores)]],
                    ["id", "n_words", "n_features", "weight", "score"])

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), key.alias("key"), utf8(F.col(text_col)).alias("text")).mapInArrow(
        score, f"id {kind}, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    buckets: int = 10_000, most: int = 1, least_words: int = 20, percent: int = 10, seed: str = "2024",
) -> DataFrame:
    """``id, n_features, weight, score, rank`` of each row of ``docs``; those not drawn have no rank.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred are drawn (rounded down): those of
    the highest scores, ties to the smaller id and then to fewer features. Ids are whole numbers.
    Null and empty texts have no features and weight 0. Rows that repeat an id have the same noise and are
    drawn each by itself; rows without an id are hashed as an empty one and lose ties. No rows: no rows. An empty
    target counts as one that holds each bucket alike. Further columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, most), bucket_counts(target, target_text, buckets, most))
    scored = durable(score_documents(docs, gains, id_col, text_col, most, seed))
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = long_enough.count() * percent // 100
    ranked = radix_rank(long_enough, [(F.col("score"), True), (F.col("id"), False), (F.col("n_features"), False)])
    columns = ["id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(
        scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
