"""Repair times, failures and effectiveness per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.constants import MONTH_OPERATING_MINUTES, SHIFT_MINUTES
from lamina.functions import indicators
from lamina.operators.intervals import uncovered

CORRECTIVE = "corrective"


def mttr() -> Column:
    """Mean corrective downtime; NULL without corrective events."""
    return F.avg(F.when(F.col("category") == CORRECTIVE, F.col("downtime_minutes").cast("double")))


def failures() -> Column:
    """Number of corrective events."""
    return F.count_if(F.col("category") == CORRECTIVE)


def mtbf(operating: Column, failure_count: Column) -> Column:
    """Operating minutes per failure; NULL without failures."""
    return F.when(failure_count > 0, operating.cast("double") / failure_count)


def mttr_total(events: DataFrame) -> DataFrame:
    """Mean time to repair over all events."""
    return events.agg(mttr().alias("mttr_minutes"))


def mtbf_total(events: DataFrame, operating_minutes: float) -> DataFrame:
    """Mean time between failures over all events."""
    return events.agg(mtbf(F.lit(operating_minutes), failures()).alias("mtbf_minutes"))


def operating_minutes(events: DataFrame) -> DataFrame:
    """Every line seen, with the nominal minutes of a month of three shifts a day."""
    minutes = F.lit(MONTH_OPERATING_MINUTES).cast("bigint")
    return events.select("line_id").distinct().withColumn("operating_minutes", minutes)


def maintenance_by_line(events: DataFrame, operating: DataFrame) -> DataFrame:
    """MTTR, MTBF, events and downtime per line; an unknown operating time counts as 0."""
    grouped = events.groupBy("line_id").agg(
        mttr().alias("mttr_minutes"),
        failures().alias("_failures"),
        F.count("*").alias("events"),
        F.sum("downtime_minutes").alias("downtime_minutes"),
    )
    minutes = F.coalesce("operating_minutes", F.lit(0))
    return grouped.join(operating, "line_id", "left").select(
        "line_id", "mttr_minutes", mtbf(minutes, F.col("_failures")).alias("mtbf_minutes"),
        "events", "downtime_minutes",
    )


def top_faults_by_downtime(events: DataFrame, limit: int = 5) -> DataFrame:
    """Faults by summed downtime of every category, worst first."""
    named = events.filter(F.length(F.col("fault_code").cast("string")) > 0)
    totals = named.groupBy("fault_code").agg(F.sum("downtime_minutes").alias("minutes"))
    return totals.orderBy(F.desc("minutes"), "fault_code").limit(limit)


def flag_longest(
    events: DataFrame, limit: int = 20, prefix: str = "MNT-RPT-"
) -> DataFrame:
    """Give the longest corrective events a report id.

    The winners are found with a distributed top-k of ``limit`` rows and joined back by id, so
    no window has to order the whole table in one task.
    """
    longest = (
        events.filter(F.col("category") == CORRECTIVE)
        .orderBy(F.desc("downtime_minutes"), "event_id")
        .select("event_id")
        .limit(limit)
        .withColumn("_winner", F.lit(True))
    )
    report = F.when(F.col("_winner"), F.concat(F.lit(prefix), F.col("event_id").cast("string")))
    flagged = events.drop("report_doc_id").join(F.broadcast(longest), "event_id", "left")
    return flagged.withColumn("report_doc_id", report).drop("_winner")


def oee_by_line(
    periods: DataFrame, planned: str = "planned_minutes", downtime: str = "downtime_minutes",
    plates: str = "plates", rejected: str = "rejected",
) -> DataFrame:
    """Add the three components and their product to rows of (planned, downtime, plates...)."""
    plan, down, made, bad = (F.col(name) for name in (planned, downtime, plates, rejected))
    return periods.withColumns(
        {
            "availability": indicators.availability(plan, down),
            "performance": indicators.performance(made, plan - down),
            "quality": indicators.quality(made, bad),
            "oee": indicators.oee(plan, down, made, bad),
        }
    )


def distinct_stops(
    events: DataFrame, line: str = "line_id", start: str = "started_at", end: str = "ended_at",
) -> DataFrame:
    """(line, period, stop_minutes): the minutes of a month in which a line stood, overlapping stops counted once.

    A stop over the end of a month counts in both. Months without a stop have no row.
    """
    alone = uncovered(events.select(line, start, end), [line], start, end)
    # The part up to an instant on the first of a month adds nothing to that month.
    last = F.col(end) - F.expr("INTERVAL 1 MICROSECOND")
    months = F.explode(F.sequence(F.trunc(start, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH")))
    each = alone.withColumn("period", months).withColumn("period", F.col("period").cast("timestamp_ntz"))
    begins = F.greatest(F.col(start), F.col("period"))
    ends = F.least(F.col(end), F.add_months(F.col("period"), 1).cast("timestamp_ntz"))
    micros = F.timestamp_diff("MICROSECOND", begins, ends)
    return each.groupBy(line, "period").agg((F.sum(micros) / 60_000_000).alias("stop_minutes"))


def planned_minutes(shift_count: Column) -> Column:
    """Planned minutes of a number of shifts."""
    return shift_count * SHIFT_MINUTES
