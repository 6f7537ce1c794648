"""Ranks by a distributed radix sort, least significant digit first.

Keys are packed into words of at most 63 bits and cut into digits. A pass sorts by one digit and keeps
the order of the passes before it. Rows lie in blocks of consecutive places. Each block counts its
digits; a row's next place is the number of rows with a smaller digit, plus those with its digit in
earlier blocks, plus those with its digit before it in its block. So no task holds more than a block,
whatever the keys are: a value that all rows share is as many cells as there are blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.session import durable

DIGIT_BITS = 11
#: Blocks have a 64th of the rows, within these bounds: a task sorts a few blocks, and one digit has
#: one row per block when offsets are added up.
LEAST_BLOCK_BITS, MOST_BLOCK_BITS = 10, 20
_WORD_BITS = 63


def _packed(offsets: list[tuple[Column, int]]) -> list[tuple[Column, int]]:
    """Words that order like the ``(offset, bits)`` in sequence, the most significant first."""
    words: list[tuple[Column, int]] = []
    for offset, bits in offsets:
        if words and words[-1][1] + bits <= _WORD_BITS:
            word, held = words[-1]
            words[-1] = (F.shiftleft(word, bits).bitwiseOR(offset), held + bits)
        elif bits:
            words.append((offset, bits))
    return words


def _digits(words: list[tuple[str, int]], most: int) -> list[Column]:
    """The digits of all words, least significant first, none wider than ``most`` bits."""
    found = []
    for name, bits in reversed(words):
        passes = -(-bits // most)
        width = -(-bits // passes)
        found += [F.shiftright(name, at * width).bitwiseAND(F.lit((1 << width) - 1)) for at in range(passes)]
    return found


def _pass(rows: DataFrame, digit: Column, block_bits: int) -> DataFrame:
    """``rows`` with the places ``at`` that a stable sort by ``digit`` gives them."""
    cell = ["block", "digit"]
    dealt = rows.withColumns({"block": F.shiftright("at", block_bits), "digit": digit})
    counts = dealt.groupBy(*cell).agg(F.count("*").alias("n"))
    earlier = W.partitionBy("digit").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # One row per digit value: at most 2 ** DIGIT_BITS of them.
    smaller = W.orderBy("digit").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(
        "digit", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("base"))
    starts = before.join(F.broadcast(bases), "digit").select(*cell, (F.col("base") + F.col("before")).alias("start"))
    inside = F.row_number().over(W.partitionBy(*cell).orderBy("at"))
    moved = dealt.withColumn("inside", inside).join(starts, cell)
    return moved.select(*[c for c in rows.columns if c != "at"], (F.col("start") + F.col("inside") - 1).alias("at"))


def radix_rank(
    df: DataFrame, keys: Sequence[tuple[Column, bool]], rank: str = "rank", digit_bits: int = DIGIT_BITS,
) -> DataFrame:
    """``df`` with the 1-based ``rank`` of each row by ``keys``: pairs of a long column and whether it descends.

    Null keys come last, in either direction. Rows with equal keys get consecutive ranks in any order.
    ``rank`` replaces a column of that name. No rows: no rows.
    """
    named = []
    for column, descends in keys:
        value = column.cast("long")
        named += [(F.when(value.isNull(), 1).otherwise(0).cast("long"), False), (F.coalesce(value, F.lit(0).cast("long")), descends)]
    columns = [c for c in df.columns if c != rank]
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(0).alias("none"))
    # Places before the first pass are partition numbers and positions: they differ and are made durable.
    rows = durable(df.select(kept.alias("row"), *[column.alias(f"k{i}") for i, (column, _) in enumerate(named)],
                             F.monotonically_increasing_id().alias("at")))
    spans = rows.agg(F.count("*"), *[f(f"k{i}") for i in range(len(named)) for f in (F.min, F.max)]).first()
    number, bounds = spans[0], list(zip(spans[1::2], spans[2::2], strict=True))
    answer = [*[F.col(f"row.`{c}`") for c in columns], (F.col("at") + 1).alias(rank)]
    if not number:
        return rows.select(*answer)
    offsets = []
    for i, ((_, descends), (low, high)) in enumerate(zip(named, bounds, strict=True)):
        offset, bits = (F.lit(high) - F.col(f"k{i}") if descends else F.col(f"k{i}") - F.lit(low)), (high - low).bit_length()
        if bits > _WORD_BITS:  # the difference is no long: halves, of which the upper one carries the sign
            halves = [F.shiftright(f"k{i}", 32), F.col(f"k{i}").bitwiseAND(F.lit(0xFFFFFFFF))]
            low_half, high_half = low >> 32, high >> 32
            offsets.append(((F.lit(high_half) - halves[0] if descends else halves[0] - F.lit(low_half)), 32))
            offsets.append((F.lit(0xFFFFFFFF) - halves[1] if descends else halves[1], 32))
        else:
            offsets.append((offset, bits))
    words = _packed(offsets)
    names = [(f"w{i}", bits) for i, (_, bits) in enumerate(words)]
    rows = rows.select("row", *[word.alias(name) for (word, _), (name, _) in zip(words, names, strict=True)], "at")
    block_bits = min(MOST_BLOCK_BITS, max(LEAST_BLOCK_BITS, (number // 64).bit_length()))
    # With all keys alike one pass is still needed, for places without gaps.
    for digit in _digits(names, digit_bits) or [F.lit(0).cast("long")]:
        rows = durable(_pass(rows, digit, block_bits))
    return rows.select(*answer)
