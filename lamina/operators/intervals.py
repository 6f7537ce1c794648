"""Intervals that overlap, counted once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.operators.ordered import laid_out, part_of


def uncovered(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The part of every interval that no interval before it in its group covers, as ``start`` and ``end``.

    Intervals are taken by start, then end; the parts of a group do not overlap and together are its
    union. An interval without a part of its own has no row, nor has one that is empty, ends before it
    starts or lacks an end. Equal intervals count once. A null key is a group.

    The rows are sorted into ranges of the whole order. What the ranges before have reached is carried
    into each range as one value a group; inside a range a running maximum does the rest. A group with
    very many intervals is many ranges, and no task holds it.
    """
    sound = df.where(F.col(end) > F.col(start))
    placed = laid_out(sound, [*keys, start, end], ties=True).withColumn("_part", part_of("_at"))
    # One row per group and range.
    reached = placed.groupBy("_part", *keys).agg(F.max(end).alias("_reached"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = reached.withColumn("_carried", F.max("_reached").over(earlier)).drop("_reached")
    met = [F.col("r._part") == F.col("c._part"), *[F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]]
    joined = placed.alias("r").join(carried.alias("c"), met).select("r.*", "c._carried")
    before = W.partitionBy("_part", *keys).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    # ``greatest`` passes over nulls: nothing was carried, or the range begins here.
    begins = F.greatest(F.col(start), F.col("_carried"), F.max(end).over(before))
    cut = joined.withColumn("_begins", begins).where(F.col("_begins") < F.col(end))
    return cut.drop(start, "_carried", "_at", "_part", "_tie").withColumnRenamed("_begins", start).select(*df.columns)
