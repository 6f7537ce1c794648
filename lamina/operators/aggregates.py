"""Aggregates that stay exact and distributed at any group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A sketch is off by up to one part in ``_ACCURACY``; a bracket reaches several times as far.
_ACCURACY = 10_000
_BRACKET = 5 / _ACCURACY


def between_ranks(position: Column, low: Column, high: Column) -> Column:
    """Linear interpolation at a fractional rank."""
    return low + (high - low) * (position - F.floor(position))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float],
    output: str = "percentile",
) -> DataFrame:
    """Linear-interpolated percentiles as rows (keys, fraction, percentile).

    A sketch of every group brackets the wanted ranks, a thousandth of the group wide. A second pass counts the rows
    below each bracket, map-side, and puts the different values inside in order. The result is exact as
    long as the wanted rank lies inside; if it ever does not, the job fails.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    if not keys:
        # One group is joined by a key as well; a literal would make it a loop over both sides.
        data = data.withColumn("_all", F.length(F.col("_v").cast("string")) < 0)
    groups = list(keys) or ["_all"]
    marks = [
        point
        for fraction in fractions
        for point in (max(fraction - _BRACKET, 0.0), min(fraction + _BRACKET, 1.0))
    ]
    sketch = data.groupBy(*groups).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", marks, _ACCURACY).alias("_marks"),
    )
    # A bracket holds a handful of ranks at least: below that many rows it is the whole group.
    whole = F.col("_n") <= 10 / _BRACKET
    brackets = F.array(
        *[
            F.struct(
                F.lit(float(fraction)).alias("fraction"),
                F.when(whole, F.col("_min")).otherwise(F.col("_marks")[2 * i]).alias("_low"),
                F.when(whole, F.col("_max")).otherwise(F.col("_marks")[2 * i + 1]).alias("_high"),
            )
            for i, fraction in enumerate(fractions)
        ]
    )
    wide = sketch.select(*groups, "_n", F.explode(brackets).alias("_b")).select(
        *groups, "_n", "_b.fraction", "_b._low", "_b._high"
    )
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"w.{k}")) for k in groups]
    met = data.alias("d").join(wide.alias("w"), on).filter("d._v <= w._high").select(
        *[F.col(f"w.{k}").alias(k) for k in groups], "fraction", "_n", "_low", "_v"
    )
    # Every row below the bracket falls into one NULL cell that is summed map-side.
    cells = met.groupBy(*groups, "fraction", "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_cell")).agg(
        F.count("*").alias("_c")
    )
    running = (
        W.partitionBy(*groups, "fraction")
        .orderBy(F.asc_nulls_first("_cell"))
        .rowsBetween(W.unboundedPreceding, 0)
    )
    counted = cells.withColumn("_cum", F.sum("_c").over(running))
    position = F.col("fraction") * (F.col("_n") - 1)
    low_rank = F.floor(position)
    high_rank = F.least(low_rank + 1, F.col("_n") - 1)
    ends = counted.groupBy(*groups, "fraction", "_n").agg(
        F.min(F.when(F.col("_cum") > low_rank, F.struct(F.col("_cell").alias("v"), "_cum"))).alias("_lo"),
        F.min(F.when(F.col("_cum") > high_rank, F.struct(F.col("_cell").alias("v"), "_cum"))).alias("_hi"),
    )
    outside = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
    found = between_ranks(position, F.col("_lo.v"), F.col("_hi.v"))
    return ends.select(*keys, "fraction", F.coalesce(found, outside).alias(output))


def pooled_ratio(part: Column, whole: Column) -> Column:
    """Ratio of the sums; NULL when nothing was counted."""
    total = F.sum(whole)
    return F.when(total != 0, F.sum(part) / total.cast("double"))


def share_true(flag: Column) -> Column:
    """Mean of a nullable flag over its non-null rows."""
    return F.avg(flag.cast("double"))


def pct_share(part: Column, total: Column, digits: int = 2) -> Column:
    """``part`` of ``total`` in percent, decimal arithmetic, NULL for an empty total."""
    return F.round(F.lit(100).cast("decimal(5,1)") * part / F.nullif(total, F.lit(0)), digits)


def rounded_decimal(aggregate: Column, digits: int) -> Column:
    """Round after a cast to decimal, half away from zero."""
    return F.round(aggregate.cast("decimal(38,10)"), digits)


def overall_and_by(
    df: DataFrame, keys: Sequence[str], category: str, aggregates: Sequence[Column],
    overall: str = "overall",
) -> DataFrame:
    """The same aggregates over every group of ``keys`` and over each of its categories.

    A category of the name ``overall`` could not be told from the totals and fails the job.
    """
    sets = [[F.col(k) for k in keys], [*[F.col(k) for k in keys], F.col(category)]]
    whole = F.grouping(F.col(category))
    grouped = df.groupingSets(sets, *keys, category).agg(*aggregates, whole.alias("_whole"))
    name = F.col(category).cast("string")
    clash = F.raise_error(F.lit(f"a category is named {overall!r}")).cast("string")
    label = F.when(F.col("_whole") == 1, overall).when(name == overall, clash).otherwise(name)
    return grouped.withColumn("scope", label).drop("_whole", category)
