"""Ranks and row frames over a total order, without one task seeing a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.session import durable

# monotonically_increasing_id keeps the partition number above this many bits of position.
_POSITION_BITS = 33


def laid_out(df: DataFrame, order: Sequence[str], ties: bool) -> DataFrame:
    """``df`` in ranges of ``order``, sorted inside, with each row's place ``_at`` made durable."""
    if ties:
        df = durable(df.withColumn("_tie", F.monotonically_increasing_id()))
        order = [*order, "_tie"]
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(ranges.withColumn("_at", F.monotonically_increasing_id()))


def part_of(place: str) -> Column:
    """The number of the range that a place of ``laid_out`` lies in."""
    return F.shiftright(place, _POSITION_BITS)


def global_rank(
    df: DataFrame, order: Sequence[str], rank: str = "rank", ties: bool = False
) -> DataFrame:
    """0-based position of every row in the order of ``order``, which must be total.

    With ``ties`` it need not be: rows get a number of their own first, so that a value which
    many rows share is spread over many partitions like any other stretch of the order.

    Rows are range-partitioned and sorted, and the layout is made durable; a row's rank is then
    its position in its partition plus the rows of the partitions before. Only that table of
    partition sizes is ordered in one place.
    """
    numbered = laid_out(df, order, ties)
    part = part_of("_at")
    inside = F.col("_at") - F.shiftleft(part, _POSITION_BITS)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    # One row per shuffle partition: bounded by the cluster's settings, not by the data.
    joined = numbered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(rank, F.col("_before") + inside).drop(
        "_at", "_part", "_before", "_tie"
    )


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "rank",
    ties: bool = False,
) -> DataFrame:
    """0-based position of every row inside its group; a hot group is ranked by many tasks.

    A group lies in consecutive ranges. Its rank is the place in the stretch of its range, plus the
    rows of the group in the ranges before. Rows meet that table by range and group, so a hot
    group is as many keys as it has ranges.
    """
    if not keys:
        return global_rank(df, order, rank, ties)
    numbered = laid_out(df, [*keys, *order], ties).withColumn("_part", part_of("_at"))
    stretches = numbered.groupBy("_part", *keys).agg(F.min("_at").alias("_start"), F.count("*").alias("_size"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = stretches.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    condition = [F.col("r._part") == F.col("o._part"), *[F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]]
    joined = numbered.alias("r").join(offsets.alias("o"), condition)
    place = F.col("r._at") - F.col("o._start") + F.col("o._before")
    return joined.select("r.*", place.alias(rank)).drop("_at", "_part", "_tie")


def moving_average(
    df: DataFrame, order: Sequence[str], value: str, preceding: int, keys: Sequence[str] = (),
    output: str = "moving_avg", block_rows: int = 1_000_000,
) -> DataFrame:
    """Mean of the current row and the ``preceding`` ones before it in its series.

    The global order is cut into blocks of ``block_rows`` rows. Each block also gets the last
    ``preceding`` rows of the block before, so every frame is complete inside one block.
    """
    if block_rows <= preceding:
        raise ValueError("block_rows must exceed the number of preceding rows")
    ranked = global_rank(df, [*keys, *order], "_rank")
    size = F.lit(block_rows)
    block = F.floor(F.col("_rank") / size)
    near_end = F.pmod("_rank", size) >= size - preceding
    copies = F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block))
    spread = ranked.withColumn("_own", block).withColumn("_block", F.explode(copies))
    frame = W.partitionBy("_block", *keys).orderBy("_rank").rowsBetween(-preceding, 0)
    averaged = spread.withColumn(output, F.avg(value).over(frame))
    return averaged.filter(F.col("_block") == F.col("_own")).drop("_rank", "_own", "_block")
