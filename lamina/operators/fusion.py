"""Ranks per retrieval branch and their reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.constants import RRF_K


def rrf_scores(branches: Sequence[DataFrame], k: int = RRF_K) -> DataFrame:
    """Fused score per (query_id, chunk_id), with the rank in every branch.

    A branch holds (query_id, chunk_id, rank); their order decides ties: an item first met in
    an earlier branch, or at a better rank of the same one, comes first.
    """
    labelled = [
        branch.select("query_id", "chunk_id", "rank", F.lit(i).alias("branch"))
        for i, branch in enumerate(branches)
    ]
    merged = reduce(DataFrame.unionByName, labelled)
    return merged.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"),
        F.min(F.struct("branch", "rank")).alias("first_seen"),
        *[
            F.min(F.when(F.col("branch") == i, F.col("rank"))).alias(f"rank_{i}")
            for i in range(len(branches))
        ],
    )


def rrf_fuse(branches: Sequence[DataFrame], limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """Fused ranking per query, cut to ``limit`` rows when given.

    Scores are compared after rounding at the 12th decimal: equal sums reached in another
    order of addition must tie.
    """
    from pyspark.sql import Window as W

    order = [F.desc(F.round("score", 12)), F.asc("first_seen")]
    window = W.partitionBy("query_id").orderBy(*order)
    ranked = rrf_scores(branches, k).withColumn("rank", F.row_number().over(window))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.drop("first_seen")
