"""Scalar definitions of the energy, OEE, hold and geometry indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.constants import (
    ALWAYS_HOLD,
    CO2_TONNES_PER_KWH,
    HOLD_HOURS,
    NOMINAL_PLATES_PER_HOUR,
)


def _ratio_or_null(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top.cast("double") / bottom)


# ---- energy ----


def energy_intensity(kwh: Column, plates: Column) -> Column:
    """kWh per plate; NULL without plates."""
    return _ratio_or_null(kwh, plates)


def co2_per_kwh(co2_tonnes: Column, kwh: Column) -> Column:
    """kg of CO2 per kWh; NULL without energy."""
    return _ratio_or_null(co2_tonnes * 1000.0, kwh)


def estimated_co2(kwh: Column) -> Column:
    """Tonnes of CO2 from the emission factor."""
    return kwh * CO2_TONNES_PER_KWH


def reactive_ratio(reactive: Column, active: Column) -> Column:
    """Reactive over active energy; NULL without active energy."""
    return _ratio_or_null(reactive, active)


# ---- overall equipment effectiveness: an empty denominator counts as 0.0 ----


def availability(planned: Column, downtime: Column) -> Column:
    """Share of planned minutes the line ran; overlapping stops cannot push it below 0."""
    ran = F.greatest(planned - downtime, F.lit(0))
    return F.when(planned > 0, ran / planned.cast("double")).otherwise(0.0)


def performance(plates: Column, run_minutes: Column) -> Column:
    """Actual over nominal rate, at most 1."""
    rate = plates / (run_minutes / 60.0)
    return F.when(run_minutes > 0, F.least(rate / NOMINAL_PLATES_PER_HOUR, F.lit(1.0))).otherwise(0.0)


def quality(plates: Column, rejected: Column) -> Column:
    """Share of plates that conform."""
    return F.when(plates > 0, (plates - rejected) / plates.cast("double")).otherwise(0.0)


def oee(planned: Column, downtime: Column, plates: Column, rejected: Column) -> Column:
    """Availability x performance x quality."""
    return (
        availability(planned, downtime)
        * performance(plates, planned - downtime)
        * quality(plates, rejected)
    )


# ---- quality hold ----


def always_held(fault: Column, codes: Sequence[str] = ALWAYS_HOLD) -> Column:
    """True for the faults that are held whatever their declared severity."""
    return F.coalesce(fault.isin(*codes), F.lit(False))


def hold_hours(fault: Column, severity: Column, codes: Sequence[str] = ALWAYS_HOLD) -> Column:
    """Hold duration: the longest for always-held faults, the shortest for unknown severities."""
    hours = F.when(always_held(fault, codes), HOLD_HOURS[3])
    for level, value in HOLD_HOURS.items():
        hours = hours.when(severity == level, value)
    return hours.otherwise(HOLD_HOURS[1])


def should_hold(fault: Column, severity: Column, codes: Sequence[str] = ALWAYS_HOLD) -> Column:
    """True when a plate may not ship yet."""
    return always_held(fault, codes) | (severity >= 2)


def is_critical(fault: Column, severity: Column, codes: Sequence[str] = ALWAYS_HOLD) -> Column:
    """True for the defects counted against a batch."""
    return always_held(fault, codes) | (severity >= 3)


# ---- defect geometry ----


def defect_geometry(
    x_min: Column, x_max: Column, y_min: Column, y_max: Column, area: Column, luminosity: Column,
    threshold: float = 4.0,
) -> dict[str, Column]:
    """All geometry measures by name; ratios over an empty extent are NULL, never elongated."""
    width, height = x_max - x_min, y_max - y_min
    box = width * height
    aspect = F.when(height != 0, width / height.cast("double"))
    elongated = (aspect >= threshold) | (aspect <= 1.0 / threshold)
    return {
        "width": width,
        "height": height,
        "aspect_ratio": aspect,
        "box_area": box,
        "fill_ratio": F.when(box != 0, area / box.cast("double")),
        "mean_luminosity": F.when(area != 0, luminosity / area.cast("double")),
        "elongated": F.coalesce(elongated, F.lit(False)),
    }
