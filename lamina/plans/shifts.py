"""Aggregates by production shift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.calendar import shift_date, shift_of


def with_shift(df: DataFrame, ts: str) -> DataFrame:
    """Add the accounting date and the shift code of ``ts``."""
    stamp = F.col(ts)
    return df.withColumns({"shift_date": shift_date(stamp), "shift_code": shift_of(stamp)})


def energy_by_shift(readings: DataFrame) -> DataFrame:
    """Energy, CO2 and intervals per accounting date and shift."""
    return with_shift(readings, "ts").groupBy("shift_date", "shift_code").agg(
        F.sum("usage_kwh").alias("kwh"),
        F.sum("co2_tco2").alias("co2"),
        F.count("*").alias("intervals"),
    )


def faults_by_shift(inspections: DataFrame) -> DataFrame:
    """Faults per accounting date, shift and fault."""
    keyed = with_shift(inspections, "inspected_at")
    return keyed.groupBy("shift_date", "shift_code", "fault_code").agg(F.count("*").alias("faults"))


def shift_totals(readings: DataFrame) -> DataFrame:
    """Energy and intervals per shift over the whole table."""
    return with_shift(readings, "ts").groupBy("shift_code").agg(
        F.sum("usage_kwh").alias("kwh"), F.count("*").alias("intervals")
    )


def busiest_shift(readings: DataFrame) -> DataFrame:
    """The shift with the most energy."""
    return shift_totals(readings).agg(F.max_by("shift_code", "kwh").alias("shift_code"))


def join_shift_range(df: DataFrame, shifts: DataFrame, ts: str) -> DataFrame:
    """Attach the row of ``shifts`` whose hour range holds ``ts``, ranges past midnight included.

    Every range is expanded to its hours (24 rows at most per covering), so the fact side meets
    it in an equi join instead of a range test per row and shift.
    """
    wraps = F.col("start_hour") > F.col("end_hour")
    span = F.when(wraps, F.col("end_hour") + 24).otherwise(F.col("end_hour")) - F.col("start_hour")
    hours = F.sequence(F.lit(0), F.lit(23))
    covered = F.filter(
        hours, lambda hour: F.pmod(hour - F.col("start_hour") + 24, F.lit(24)) < span
    )
    by_hour = shifts.withColumn("_hour", F.explode(covered))
    return df.withColumn("_hour", F.hour(ts)).join(by_hour, "_hour").drop("_hour")
