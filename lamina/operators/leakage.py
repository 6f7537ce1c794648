"""Evaluation questions that overlap the examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.constants import LEAKAGE_SIMILARITY
from lamina.functions.text import normalise_text
from lamina.operators.search import knn_exact


def leakage_exact(
    questions: DataFrame, examples: DataFrame, text: str = "text", example_text: str = "text"
) -> DataFrame:
    """Questions whose text equals an example's once case, accents and punctuation are gone."""
    keys = examples.select(normalise_text(F.col(example_text)).alias("_norm")).distinct()
    normal = questions.withColumn("_norm", normalise_text(F.col(text)))
    return normal.join(keys, "_norm", "left_semi").drop("_norm")


def leakage_embedding(
    questions: DataFrame, examples: DataFrame, limit: float = LEAKAGE_SIMILARITY, **columns: str
) -> DataFrame:
    """The closest example of every question that is more similar to it than ``limit``."""
    best = knn_exact(questions, examples, 1, **columns)
    return best.filter(F.col("score") > limit).select(
        F.col("query_id").alias("question_id"), F.col("chunk_id").alias("example_id"),
        F.col("score").alias("similarity"),
    )


def best_similarity(questions: DataFrame, examples: DataFrame, **columns: str) -> DataFrame:
    """The closest example of every question, whatever its similarity."""
    return knn_exact(questions, examples, 1, **columns)
