"""Relational shapes that Spark has no single call for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.constants import DEFAULT_ROW_LIMIT, PREVIEW_ROWS
from lamina.session import durable

# monotonically_increasing_id keeps the partition number above this many bits of position.
PARTITION_BITS = 33


def limit_default(df: DataFrame, limit: int = DEFAULT_ROW_LIMIT, bare_aggregate: bool = False) -> DataFrame:
    """Cap an unlimited result; an ungrouped aggregate is one row already and is left alone."""
    return df if bare_aggregate else df.limit(limit)


def result_preview(df: DataFrame, shown: int = PREVIEW_ROWS) -> tuple[DataFrame, DataFrame]:
    """The first rows of a result, and one row (row_count, truncated) about all of it.

    The result is computed once: its rows are counted as they pass on their way to the first ones,
    which are written.
    """
    seen = Observation()
    placed = df.withColumn("_at", F.monotonically_increasing_id()).observe(seen, F.count(F.lit(1)).alias("row_count"))
    # Each partition keeps its first rows; sorting these does not run the plan again.
    inside = F.col("_at").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    few = durable(placed.where(inside < shown))
    count = seen.get["row_count"]
    summary = df.sparkSession.createDataFrame([(count, count > shown)], "row_count bigint, truncated boolean")
    return few.orderBy("_at").limit(shown).drop("_at"), summary


def filter_metadata(df: DataFrame, filters: Mapping[str, object], metadata: str = "metadata") -> DataFrame:
    """Rows whose metadata map equals every given value, compared as text."""
    for key, value in filters.items():
        df = df.filter(F.col(metadata)[key] == str(value))
    return df


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, rank: str = "rank"
) -> DataFrame:
    """The first ``limit`` rows of every group with their 1-based rank.

    Spark plans a group limit below the shuffle, so each task forwards at most ``limit`` rows
    per group however many rows a hot group has.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every group."""
    return top_per_group(df, keys, order, 1, rank="_first").drop("_first")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """As ``distinct_on`` for ascending plain columns, as an aggregate that combines map-side."""
    picked = F.min(F.struct(*order, *[F.col(c).alias(f"_k_{c}") for c in keep]))
    chosen = df.groupBy(*keys).agg(picked.alias("_p"))
    return chosen.select(*keys, *[F.col(f"_p._k_{c}").alias(c) for c in keep])


def anti_references(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str
) -> DataFrame:
    """Keys of either side that the other side lacks, as (side, key)."""
    a = left.select(F.col(left_key).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    b = right.select(F.col(right_key).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    only_a = a.join(b, "key", "left_anti").select(F.lit("left").alias("side"), "key")
    only_b = b.join(a, "key", "left_anti").select(F.lit("right").alias("side"), "key")
    return only_a.unionByName(only_b)


def exists_flag(keys: DataFrame, table: DataFrame, key: str, flag: str = "found") -> DataFrame:
    """Every key with whether ``table`` holds it; the table is reduced to its distinct keys."""
    present = table.select(key).distinct().withColumn(flag, F.lit(True))
    return keys.join(present, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unnest_pairs(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """One row per position of several arrays walked in step."""
    zipped = F.explode(F.arrays_zip(*arrays)).alias("_z")
    return df.select(*keys, zipped).select(*keys, *[F.col(f"_z.{a}").alias(a) for a in arrays])


def lateral_topk(
    left: DataFrame, right: DataFrame, key: str, order: Sequence[Column], limit: int
) -> DataFrame:
    """For every left row its best ``limit`` right rows.

    The right side is cut to ``limit`` rows per key before the join instead of being ordered
    again for every left row.
    """
    return left.join(top_per_group(right, [key], order, limit), key)
