"""Energy indicators over tables of 15-minute readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.constants import (
    INTERVAL_HOURS,
    PEAK_LOAD_ALERT_KWH,
    POWER_FACTOR_MIN_PCT,
    POWER_FACTOR_PENALTY_PCT,
)
from lamina.functions import calendar, indicators


def peak_intervals(readings: DataFrame, limit_kwh: float = PEAK_LOAD_ALERT_KWH) -> DataFrame:
    """Intervals strictly above the alert threshold."""
    return readings.filter(F.col("usage_kwh") > limit_kwh).select("ts", "usage_kwh")


def monthly_summary(readings: DataFrame, plates_by_month: DataFrame) -> DataFrame:
    """Energy, CO2 ratio and intensity by month number; years are merged.

    ``plates_by_month`` holds (month, plates); a month without plates has no intensity.
    """
    by_month = readings.groupBy(F.month("ts").alias("month")).agg(
        F.sum("usage_kwh").alias("kwh"), F.sum("co2_tco2").alias("co2")
    )
    plates = F.coalesce("plates", F.lit(0))
    return by_month.join(plates_by_month, "month", "left").select(
        "month",
        "kwh",
        indicators.co2_per_kwh(F.col("co2"), F.col("kwh")).alias("co2_kg_per_kwh"),
        indicators.energy_intensity(F.col("kwh"), plates).alias("intensity"),
    )


def intensity_by_period(readings: DataFrame, plates: DataFrame) -> DataFrame:
    """kWh per plate by calendar month; each side is reduced to months before the join."""
    energy = readings.groupBy(calendar.month_start(F.col("ts")).alias("period")).agg(
        F.sum("usage_kwh").alias("kwh")
    )
    made = plates.groupBy(calendar.month_start(F.col("inspected_at")).alias("period")).agg(
        F.count("*").alias("plates")
    )
    count = F.coalesce("plates", F.lit(0).cast("bigint"))
    return energy.join(made, "period", "left").select(
        "period", "kwh", count.alias("plates"),
        indicators.energy_intensity(F.col("kwh"), count).alias("intensity"),
    )


def poor_power_factor(readings: DataFrame, limit: float = POWER_FACTOR_MIN_PCT) -> DataFrame:
    """Intervals below the alert power factor."""
    return readings.filter(F.col("lagging_current_power_factor") < limit).select(
        "ts",
        F.col("lagging_current_power_factor").alias("power_factor"),
        "usage_kwh",
        F.col("lagging_current_reactive_power_kvarh").alias("reactive_kvarh"),
    )


def worst_intervals(readings: DataFrame, limit: int = 10) -> DataFrame:
    """The flagged intervals with the lowest power factor."""
    flagged = poor_power_factor(readings)
    return flagged.orderBy("power_factor", "ts", "usage_kwh", "reactive_kvarh").limit(limit)


def reactive_summary(readings: DataFrame) -> DataFrame:
    """Reactive over active energy of the whole table."""
    totals = readings.agg(
        F.sum("lagging_current_reactive_power_kvarh").alias("reactive"),
        F.sum("usage_kwh").alias("active"),
    )
    ratio = indicators.reactive_ratio(F.col("reactive"), F.col("active"))
    return totals.select("reactive", "active", ratio.alias("reactive_ratio"))


def penalty_hours(readings: DataFrame) -> DataFrame:
    """Hours spent strictly below the contractual power factor."""
    below = F.count_if(F.col("lagging_current_power_factor") < POWER_FACTOR_PENALTY_PCT)
    return readings.agg((below * INTERVAL_HOURS).alias("penalty_hours"))


def energy_by_load_type(readings: DataFrame) -> DataFrame:
    """Intervals, energy and CO2 by load type, largest first."""
    def rounded(aggregate, digits: int, name: str):
        return F.round(aggregate.cast("decimal(38,10)"), digits).alias(name)

    return (
        readings.groupBy("load_type")
        .agg(
            F.count("*").alias("nb_intervalles"),
            rounded(F.sum("usage_kwh"), 1, "total_kwh"),
            rounded(F.sum("co2_tco2"), 3, "total_tco2"),
            rounded(F.avg("usage_kwh"), 2, "moyenne_kwh"),
        )
        .orderBy(F.desc("total_kwh"), "load_type")
    )


def peak_energy_intervals(readings: DataFrame) -> DataFrame:
    """Peak intervals with their context, highest first."""
    return (
        readings.filter(F.col("usage_kwh") > PEAK_LOAD_ALERT_KWH)
        .select("ts", "usage_kwh", "load_type", "lagging_current_power_factor")
        .orderBy(F.desc("usage_kwh"), "ts")
    )


def check_completeness(readings: DataFrame, year: int) -> DataFrame:
    """Expected and actual intervals of a 365-day year, as one row."""
    expected = 365 * 24 * 4
    count = F.count("*")
    in_year = readings.filter(F.year("ts") == year) if year else readings
    return in_year.agg(
        F.lit(expected).cast("bigint").alias("expected"),
        count.alias("actual"),
        (count == expected).alias("complete"),
    )


def missing_intervals(readings: DataFrame, first: str, last: str, minutes: int = 15) -> DataFrame:
    """Expected instants from ``first`` to ``last`` that no reading carries."""
    spark = readings.sparkSession
    grid = spark.sql(
        f"SELECT explode(sequence(TIMESTAMP_NTZ '{first}', TIMESTAMP_NTZ '{last}', "
        f"INTERVAL {minutes} MINUTES)) AS ts"
    )
    return grid.join(readings.select("ts"), "ts", "left_anti")
