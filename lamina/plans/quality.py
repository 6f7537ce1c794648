"""Quality holds and fault reports over plate inspections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.constants import ALWAYS_HOLD, CRITICAL_RATE_LIMIT
from lamina.functions import indicators
from lamina.functions.calendar import month_start

# No join here carries a broadcast hint. Dimension tables are broadcast when their measured
# size allows it and joined by shuffle, with adaptive skew splitting, when it does not.


def hold_summary(
    plates: DataFrame, batch: str, fault: str = "fault_code", severity: str = "severity",
    always_hold: Sequence[str] = ALWAYS_HOLD,
) -> DataFrame:
    """Held and released plates per batch, and whether its critical share needs a review."""
    held = indicators.should_hold(F.col(fault), F.col(severity), always_hold)
    critical = indicators.is_critical(F.col(fault), F.col(severity), always_hold)
    rate = F.count_if(critical) / F.count("*")
    return plates.groupBy(batch).agg(
        F.count_if(held).alias("held"),
        F.count_if(~held).alias("released"),
        (rate > CRITICAL_RATE_LIMIT).alias("manual_review"),
    )


def fault_counts_by_line(plates: DataFrame, lines: DataFrame, faults: DataFrame) -> DataFrame:
    """Plates per line and fault, most frequent first.

    Plates are counted by their two keys before the dimensions are joined: the joins then see
    one row per (line, fault), a hot fault costs nothing, and no second grouping by the labels
    follows because both keys are unique in their dimension.
    """
    counted = plates.groupBy("line_id", "fault_code").agg(F.count("*").alias("nb_toles"))
    named = counted.join(lines.select("line_id", F.col("name_fr").alias("ligne")), "line_id").join(
        faults.select("fault_code", F.col("label_fr").alias("libelle_defaut"), "severity"),
        "fault_code",
    )
    return named.select(
        "line_id", "ligne", "fault_code", "libelle_defaut", "severity", "nb_toles"
    ).orderBy(F.desc("nb_toles"), "line_id", "fault_code")


def monthly_fault_trend(plates: DataFrame, faults: DataFrame) -> DataFrame:
    """Critical and total faults per month with the critical share in percent."""
    counted = plates.groupBy(
        month_start(F.col("inspected_at")).alias("mois"), "fault_code"
    ).agg(F.count("*").alias("_n"))
    joined = counted.join(faults.select("fault_code", "severity"), "fault_code")
    critical = F.coalesce(F.sum(F.when(F.col("severity") == 3, F.col("_n"))), F.lit(0))
    total = F.sum("_n")
    share = F.lit(100).cast("decimal(5,1)") * critical / F.nullif(total, F.lit(0))
    return (
        joined.groupBy("mois")
        .agg(
            critical.cast("bigint").alias("defauts_critiques"),
            total.alias("defauts_total"),
            F.round(share, 2).alias("part_critiques_pct"),
        )
        .orderBy("mois")
    )


def downtime_by_fault(events: DataFrame, faults: DataFrame) -> DataFrame:
    """Corrective interventions and downtime per fault."""
    corrective = events.filter(F.col("category") == "corrective")
    grouped = corrective.groupBy("fault_code").agg(
        F.count("*").alias("nb_interventions"),
        F.sum("downtime_minutes").alias("minutes_arret"),
    )
    mean = F.round(
        F.col("minutes_arret").cast("decimal(30,6)") / F.col("nb_interventions"), 1
    )
    return (
        grouped.join(faults.select("fault_code", "label_fr"), "fault_code")
        .select(
            "fault_code", F.col("label_fr").alias("libelle_defaut"), "nb_interventions",
            "minutes_arret", mean.alias("moyenne_minutes"),
        )
        .orderBy(F.desc("minutes_arret"), "fault_code")
    )


def plates_on_hold(
    plates: DataFrame, faults: DataFrame, columns: Sequence[str],
    always_hold: Sequence[str] = ALWAYS_HOLD, fault: str = "fault_code",
) -> DataFrame:
    """Plates of a held fault, in order of inspection."""
    held = faults.filter(indicators.should_hold(F.col(fault), F.col("severity"), always_hold))
    joined = plates.join(held.select("fault_code", "severity"), "fault_code")
    return joined.select(*columns, "severity").orderBy("inspected_at", *columns)
