"""The monthly report and the facts that documents are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.constants import PEAK_LOAD_ALERT_KWH
from lamina.functions import calendar, indicators
from lamina.operators.aggregates import exact_percentiles
from lamina.operators.relational import distinct_on
from lamina.plans import maintenance, shifts


def _long(df: DataFrame, section: str, key, metrics: dict) -> DataFrame:
    """Rows (section, key, metric, value) out of one column per metric."""
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
            for name, value in metrics.items()
        ]
    )
    rows = df.select(F.lit(section).alias("section"), key.cast("string").alias("key"),
                     F.explode(entries).alias("_m"))
    return rows.select("section", "key", "_m.metric", "_m.value")


def monthly_report(
    readings: DataFrame, inspections: DataFrame, events: DataFrame, year: int, month: int
) -> DataFrame:
    """Energy, shift, quality and maintenance figures of one month as long rows.

    The number of plates produced is the number of inspections of the month.
    """
    r = readings.filter(calendar.in_month(F.col("ts"), year, month))
    i = inspections.filter(calendar.in_month(F.col("inspected_at"), year, month))
    e = events.filter(calendar.in_month(F.col("started_at"), year, month))

    made = i.agg(F.count("*").alias("plates"))
    energy = r.agg(
        F.coalesce(F.sum("usage_kwh"), F.lit(0.0)).alias("kwh"),
        F.coalesce(F.sum("co2_tco2"), F.lit(0.0)).alias("co2"),
        F.count_if(F.col("usage_kwh") > PEAK_LOAD_ALERT_KWH).alias("peaks"),
    )
    # Two one-row aggregates side by side.
    totals = energy.withColumn("_one", F.lit(1)).join(made.withColumn("_one", F.lit(1)), "_one")
    whole = F.lit("all")
    parts = [
        _long(
            totals, "energy", whole,
            {
                "total_kwh": F.col("kwh"),
                "co2_kg_per_kwh": indicators.co2_per_kwh(F.col("co2"), F.col("kwh")),
                "intensity_kwh_per_plate": indicators.energy_intensity(
                    F.col("kwh"), F.col("plates")
                ),
                "peak_intervals": F.col("peaks"),
            },
        ),
        _long(
            shifts.shift_totals(r), "shifts", F.col("shift_code"),
            {"kwh": F.col("kwh"), "intervals": F.col("intervals")},
        ),
        _long(made, "quality", whole, {"inspections": F.col("plates")}),
        _long(
            i.groupBy("fault_code").agg(F.count("*").alias("n")), "quality.faults",
            F.col("fault_code"), {"count": F.col("n")},
        ),
        _long(
            maintenance.maintenance_by_line(e, maintenance.operating_minutes(e)),
            "maintenance.by_line", F.col("line_id"),
            {
                name: F.col(name)
                for name in ("mttr_minutes", "mtbf_minutes", "events", "downtime_minutes")
            },
        ),
        _long(
            maintenance.top_faults_by_downtime(e), "maintenance.top_faults", F.col("fault_code"),
            {"minutes": F.col("minutes")},
        ),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def plant_facts(
    lines: DataFrame, faults: DataFrame, shift_table: DataFrame, plates: DataFrame,
    events: DataFrame, readings: DataFrame,
) -> dict[str, DataFrame]:
    """The eight fact tables behind the document corpus."""
    per_fault = plates.groupBy("fault_code").agg(F.count("*").alias("plate_count"))
    per_pair = plates.groupBy("fault_code", "line_id").agg(F.count("*").alias("n"))
    top_fault = distinct_on(
        per_pair, ["line_id"], [F.desc("n"), F.col("fault_code")]
    ).select("line_id", F.col("fault_code").alias("top_fault"))

    def rounded(aggregate, digits: int):
        return F.round(aggregate.cast("decimal(38,10)"), digits)

    return {
        "faults": faults.join(per_fault, "fault_code", "left").withColumn(
            "plate_count", F.coalesce("plate_count", F.lit(0).cast("bigint"))
        ),
        "lines": lines,
        "reports": events.filter(F.col("report_doc_id").isNotNull()).join(
            faults.select("fault_code", F.col("label_fr").alias("fault_label_fr"), "severity"),
            "fault_code", "left",
        ),
        "shifts": shift_table.select("shift_code", "label_fr", "start_hour", "end_hour"),
        "top_line_by_fault": distinct_on(
            per_pair, ["fault_code"], [F.desc("n"), F.col("line_id")]
        ),
        "line_stats": per_pair.groupBy("line_id").agg(F.sum("n").alias("plates")).join(
            top_fault, "line_id"
        ),
        "peak_threshold": exact_percentiles(readings, [], "usage_kwh", [0.95]),
        "energy": readings.agg(
            rounded(F.sum("usage_kwh"), 1).alias("total_kwh"),
            rounded(F.sum("co2_tco2"), 2).alias("total_tco2"),
            rounded(F.max("usage_kwh"), 2).alias("max_kwh"),
        ),
    }
