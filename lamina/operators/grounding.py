"""Whether the numbers of an answer occur in its evidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.constants import GROUNDING_TOLERANCE, TRIVIAL_NUMBERS, YEAR_RANGE
from lamina.functions.numbers import bare_number, bare_value, written_numbers


# Kinds of cells: by scale for either sign, by whole number, and for what no double can hold.
_NEGATIVE, _POSITIVE, _WHOLE, _INFINITE = 0, 1, 2, 3


def extract_numbers(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, position, written, value) per number of a text.

    Whatever the pattern finds has a value, so no filter follows. The bare form is a column of
    its own, or the optimizer would repeat it in every branch of the value.
    """
    found = df.select(key, F.posexplode(written_numbers(F.col(text))).alias("position", "written"))
    bare = found.withColumn("_bare", bare_number(F.col("written")))
    return bare.select(key, "position", "written", bare_value(F.col("_bare")).alias("value"))


def is_trivial(value: Column) -> Column:
    """Small counts, 100 and whole years, which are not claims."""
    first, last = YEAR_RANGE
    year = value.between(first, last) & (value == F.floor(value))
    return value.isin(*TRIVIAL_NUMBERS) | year


def _scale_cell(value: Column, tolerance: float) -> Column:
    """Logarithmic cell no wider than the tolerance, so a match is at most one cell away."""
    return F.floor(F.log(F.abs(value)) / (-math.log1p(-tolerance))).cast("double")


def _keys(value: Column, tolerance: float, reach: int) -> Column:
    """Cells a number is filed under (reach 0) or looked up in (reach 1)."""
    cell = _scale_cell(value, tolerance)
    kind = F.when(value < 0, _NEGATIVE).otherwise(_POSITIVE)
    relative = [
        F.struct(kind.alias("kind"), (cell + step).alias("cell"))
        for step in range(-reach, reach + 1)
    ]
    # Adding 0.0 turns a negative zero into zero.
    whole = F.struct(F.lit(_WHOLE).alias("kind"), (F.rint(value) + 0.0).alias("cell"))
    # Below 1e-9 only the whole-number rule can apply, and it always does.
    # A run of over 300 digits has no finite value; it equals others of its sign.
    infinite = F.array(F.struct(F.lit(_INFINITE).alias("kind"), F.signum(value).alias("cell")))
    # From here on, numbers less than 1 apart are within the tolerance, so whole numbers decide nothing.
    apart = 1 / tolerance + 2 if tolerance > 0 else float("inf")
    return (
        F.when(F.abs(value) == float("inf"), infinite).when(F.abs(value) >= apart, F.array(*relative))
        .when(F.abs(value) >= 1e-9, F.array(*relative, whole)).otherwise(F.array(whole))
    )


def _grounded(
    asked: DataFrame, evidence: DataFrame, key: str, text: str, tolerance: float
) -> DataFrame:
    """The different numbers of ``asked`` (key, value) that the evidence of their key holds, perhaps repeatedly.

    Evidence is reduced to the smallest and largest number per (key, cell) and met by equi join; what meets is bare
    numbers, and only those that match go on.
    """
    filed = extract_numbers(evidence, key, text).select(
        key, "value", F.explode(_keys(F.col("value"), tolerance, 0)).alias("_k")
    )
    cells = filed.groupBy(key, F.col("_k.kind").alias("_kind"), F.col("_k.cell").alias("_cell")).agg(
        F.min("value").alias("_least"), F.max("value").alias("_most")
    )
    sought = asked.select(key, "value", F.explode(_keys(F.col("value"), tolerance, 1)).alias("_k")).select(
        key, "value", F.col("_k.kind").alias("_kind"), F.col("_k.cell").alias("_cell"))
    value = F.col("value")

    def close(other: Column) -> Column:
        scale = F.greatest(F.abs(value), F.abs(other), F.lit(1e-9))
        return F.abs(other - value) / scale <= tolerance

    whole = (F.col("_most") > value - 1) & (F.col("_least") < value + 1)
    near = close(F.col("_least")) | close(F.col("_most"))
    same = F.col("_least").isNotNull()
    match = F.when(F.col("_kind") == _WHOLE, whole).when(F.col("_kind") == _INFINITE, same).otherwise(near)
    return sought.join(cells, [key, "_kind", "_cell"]).where(match).select(key, "value")


def ground_numbers(
    answers: DataFrame, evidence: DataFrame, key: str = "id", answer: str = "answer",
    text: str = "evidence", tolerance: float = GROUNDING_TOLERANCE, skip_trivial: bool = True,
) -> DataFrame:
    """One row per checked number of an answer with whether its evidence holds it.

    ``evidence`` has one row per tool output. A number matches when it is within the relative
    tolerance, or rounds to the same whole number less than 1 away. Evidence is reduced to the
    smallest and largest number per (answer, cell) and met by equi join: an answer with huge
    evidence costs one row per cell, and its numbers are never paired one by one.
    """
    counted = _by_answer(answers, evidence, key, answer, text, tolerance, skip_trivial)
    each = counted.select(key, F.explode("_numbers").alias("_n"), "_found")
    return each.select(
        key, "_n.position", "_n.written", "_n.value",
        F.coalesce(F.array_contains("_found", F.col("_n.value")), F.lit(False)).alias("grounded"))


def _by_answer(
    answers: DataFrame, evidence: DataFrame, key: str, answer: str, text: str, tolerance: float, skip_trivial: bool,
) -> DataFrame:
    """Per key: ``_copies``, the rows of ``answers``; ``_numbers``, the different (position, written, value) checked in them;
    ``_found``, the values among these that the evidence holds, NULL if none."""
    written = F.transform(written_numbers(F.col(answer)), lambda w, at: F.struct(at.alias("position"), w.alias("written"), bare_number(w).alias("bare")))
    listed = F.transform(written, lambda n: F.struct(n["position"].alias("position"), n["written"].alias("written"), bare_value(n["bare"]).alias("value")))
    checked = F.filter(listed, lambda n: ~is_trivial(n["value"])) if skip_trivial else listed
    numbers = answers.select(key, F.coalesce(checked, F.array().cast("array<struct<position:int,written:string,value:double>>")).alias("_n"))
    per_key = numbers.groupBy(key).agg(
        F.count("*").alias("_copies"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_n")))).alias("_numbers"))
    asked = per_key.select(key, F.explode(F.array_distinct(F.col("_numbers.value"))).alias("value"))
    found = _grounded(asked, evidence, key, text, tolerance).groupBy(key).agg(F.collect_set("value").alias("_found"))
    return per_key.join(found, key, "left")


def grounding_check(
    answers: DataFrame, evidence: DataFrame, key: str = "id", answer: str = "answer", text: str = "evidence",
    tolerance: float = GROUNDING_TOLERANCE, skip_trivial: bool = True,
) -> DataFrame:
    """Checked and grounded counts per answer, with the ungrounded numbers as written.

    Answers are put together once a key, with all their numbers; answers without a key hold none.
    """
    counted = _by_answer(answers, evidence, key, answer, text, tolerance, skip_trivial)
    numbers = F.when(F.col(key).isNotNull(), F.col("_numbers")).otherwise(F.slice("_numbers", 1, 0))
    found = F.coalesce("_found", F.array().cast("array<double>"))
    missed = F.filter(numbers, lambda n: ~F.array_contains(found, n["value"]))
    return counted.select(
        key,
        F.size(numbers).cast("bigint").alias("numbers_checked"),
        (F.size(numbers) - F.size(missed)).cast("bigint").alias("numbers_grounded"),
        F.transform(missed, lambda m: m["written"]).alias("ungrounded"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy"),
    ).drop("_copy")


def grounding_ratio(checked: Column, grounded: Column) -> Column:
    """Share of checked numbers that were found; 1.0 when none was checked."""
    return F.when(checked == 0, 1.0).otherwise(grounded / checked.cast("double"))
