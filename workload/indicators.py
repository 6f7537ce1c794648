"""Energy, shift, maintenance, effectiveness, hold and geometry indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import calendar, indicators
from lamina.plans import energy, maintenance, quality, reports, shifts
from workload import tables as t
from workload.registry import query
from workload.tables import ts

HELD_LABELS = ("PROMO", "LARGE")
_HELD = "label_fr IN ('PROMO', 'LARGE')"
_SHIFT = (
    "CASE WHEN hour({0}) >= 6 AND hour({0}) < 14 THEN 'M' WHEN hour({0}) >= 14 AND hour({0}) < 22 "
    "THEN 'A' ELSE 'N' END"
)
_SHIFT_DATE = "strftime(CAST({0} AS DATE) - CASE WHEN hour({0}) < 6 THEN 1 ELSE 0 END, '%Y-%m-%d')"


def _month(column: str) -> str:
    return ts(f"date_trunc('month', {column})")


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _rounded(df, digits: int = 6):
    """Every floating column rounded; sums of doubles depend on their order."""
    return df.select(*[_r(n, digits) if k == "double" else F.col(n) for n, k in df.dtypes])


# ---- calendar ----


@query(
    "ts_parse_day_first",
    f"SELECT event_id, CASE WHEN event_type <> 'error' THEN {ts("date_trunc('minute', ts)")} "
    f"WHEN day(ts) <= 12 THEN {ts('make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), 0.0)')} "
    "END AS parsed FROM events",
)
def _(spark, sf):
    # One event type is written month first: read day first, it gives another date or NULL.
    month_first = F.col("event_type") == "error"
    written = F.when(month_first, F.date_format("ts", "MM/dd/yyyy HH:mm")).otherwise(
        F.date_format("ts", "dd/MM/yyyy HH:mm")
    )
    return t.table(spark, sf, "events").select(
        "event_id", calendar.try_parse_day_first(written).alias("parsed")
    )


@query(
    "ts_interval_start",
    f"SELECT event_id, {ts('ts - INTERVAL 15 MINUTE')} AS started FROM events",
)
def _(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", calendar.interval_start(F.col("ts")).alias("started")
    )


@query("shift_of", f"SELECT event_id, {_SHIFT.format('ts')} AS shift_code FROM events")
def _(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", calendar.shift_of(F.col("ts")).alias("shift_code")
    )


@query("shift_date", f"SELECT event_id, {_SHIFT_DATE.format('ts')} AS shift_date FROM events")
def _(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", calendar.shift_date(F.col("ts")).alias("shift_date")
    )


@query(
    "check_completeness",
    "SELECT CAST(35040 AS BIGINT) AS expected, count(*) AS actual, count(*) = 35040 AS complete "
    "FROM (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events WHERE year(ts) = 2024)",
)
def _(spark, sf):
    quarter = F.window(F.col("ts"), "15 minutes")["start"].cast("timestamp_ntz")
    buckets = t.table(spark, sf, "events").select(quarter.alias("ts")).distinct()
    return energy.check_completeness(buckets, 2024)


@query(
    "missing_intervals",
    f"SELECT {ts('g')} AS ts FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', "
    "TIMESTAMP '2024-12-31 23:45:00', INTERVAL 15 MINUTE)) AS g) WHERE g NOT IN "
    "(SELECT time_bucket(INTERVAL 15 MINUTE, ts) FROM events)",
)
def _(spark, sf):
    quarter = F.window(F.col("ts"), "15 minutes")["start"].cast("timestamp_ntz")
    buckets = t.table(spark, sf, "events").select(quarter.alias("ts")).distinct()
    return energy.missing_intervals(buckets, "2024-01-01 00:00:00", "2024-12-31 23:45:00")


# ---- energy ----


@query(
    "energy_intensity",
    f"SELECT {_month('period')} AS period, round(kwh, 4) AS kwh, coalesce(plates, 0) AS plates, "
    "round(CASE WHEN plates > 0 THEN kwh / plates END, 6) AS intensity FROM (SELECT "
    "date_trunc('month', started_at) AS period, sum(downtime_minutes) AS kwh FROM maintenance "
    "GROUP BY 1) LEFT JOIN (SELECT date_trunc('month', inspected_at) AS period, count(*) AS plates "
    "FROM plates GROUP BY 1) USING (period)",
    "maintenance", "plates",
)
def _(spark, sf):
    # Events and inspections do not share months, so order amounts stand in for energy.
    readings = t.maintenance(spark, sf).select(
        F.col("started_at").alias("ts"), F.col("downtime_minutes").cast("double").alias("usage_kwh")
    )
    found = energy.intensity_by_period(readings, t.plates(spark, sf))
    return found.select("period", _r("kwh", 4), "plates", _r("intensity"))


@query(
    "co2_per_kwh",
    "SELECT load_type, round(sum(co2_tco2) * 1000.0 / sum(usage_kwh), 6) AS ratio FROM energy "
    "GROUP BY load_type",
    "energy",
)
def _(spark, sf):
    ratio = indicators.co2_per_kwh(F.sum("co2_tco2"), F.sum("usage_kwh"))
    return t.energy(spark, sf).groupBy("load_type").agg(F.round(ratio, 6).alias("ratio"))


@query(
    "estimated_co2",
    "SELECT event_id, round(usage_kwh * 0.000512, 8) AS co2 FROM energy", "energy",
)
def _(spark, sf):
    co2 = indicators.estimated_co2(F.col("usage_kwh"))
    return t.energy(spark, sf).select("event_id", F.round(co2, 8).alias("co2"))


@query(
    "peak_intervals",
    f"SELECT {ts('ts')} AS ts, usage_kwh FROM energy WHERE usage_kwh > 99.0", "energy",
)
def _(spark, sf):
    return energy.peak_intervals(t.energy(spark, sf))


@query(
    "monthly_summary",
    "SELECT CAST(m AS INTEGER) AS month, round(kwh, 4) AS kwh, round(co2 * 1000.0 / kwh, 6) AS "
    "co2_kg_per_kwh, round(CASE WHEN plates > 0 THEN kwh / plates END, 6) AS intensity FROM "
    "(SELECT month(ts) AS m, sum(usage_kwh) AS kwh, sum(co2_tco2) AS co2 FROM energy GROUP BY 1) "
    "LEFT JOIN (SELECT month(inspected_at) AS m, count(*) AS plates FROM plates GROUP BY 1) USING (m)",
    "energy", "plates",
)
def _(spark, sf):
    by_month = t.plates(spark, sf).groupBy(F.month("inspected_at").alias("month")).agg(
        F.count("*").alias("plates")
    )
    found = energy.monthly_summary(t.energy(spark, sf), by_month)
    return found.select("month", _r("kwh", 4), _r("co2_kg_per_kwh"), _r("intensity"))


@query(
    "poor_power_factor",
    f"SELECT {ts('ts')} AS ts, lagging_current_power_factor AS power_factor, usage_kwh, "
    "lagging_current_reactive_power_kvarh AS reactive_kvarh FROM energy "
    "WHERE lagging_current_power_factor < 92.0",
    "energy",
)
def _(spark, sf):
    return energy.poor_power_factor(t.energy(spark, sf))


@query(
    "reactive_ratio",
    "SELECT round(r, 4) AS reactive, round(a, 4) AS active, round(r / a, 6) AS reactive_ratio FROM "
    "(SELECT sum(lagging_current_reactive_power_kvarh) AS r, sum(usage_kwh) AS a FROM energy)",
    "energy",
)
def _(spark, sf):
    found = energy.reactive_summary(t.energy(spark, sf))
    return found.select(_r("reactive", 4), _r("active", 4), _r("reactive_ratio"))


@query(
    "penalty_hours",
    "SELECT CAST(count(*) * 0.25 AS DOUBLE) AS penalty_hours FROM energy "
    "WHERE lagging_current_power_factor < 90.0",
    "energy",
)
def _(spark, sf):
    return energy.penalty_hours(t.energy(spark, sf))


@query(
    "energy_by_shift",
    f"SELECT {_SHIFT_DATE.format('ts')} AS shift_date, {_SHIFT.format('ts')} AS shift_code, "
    "round(sum(usage_kwh), 4) AS kwh, round(sum(co2_tco2), 6) AS co2, count(*) AS intervals "
    "FROM energy GROUP BY 1, 2",
    "energy",
)
def _(spark, sf):
    found = shifts.energy_by_shift(t.energy(spark, sf))
    return found.select("shift_date", "shift_code", _r("kwh", 4), _r("co2"), "intervals")


@query(
    "faults_by_shift",
    f"SELECT {_SHIFT_DATE.format('ts')} AS shift_date, {_SHIFT.format('ts')} AS shift_code, "
    "event_type AS fault_code, count(*) AS faults FROM events GROUP BY 1, 2, 3",
)
def _(spark, sf):
    # Ship dates carry no time of day, so events stand in for inspections.
    inspections = t.table(spark, sf, "events").select(
        F.col("ts").alias("inspected_at"), F.col("event_type").alias("fault_code")
    )
    return shifts.faults_by_shift(inspections)


@query(
    "shift_totals",
    f"SELECT {_SHIFT.format('ts')} AS shift_code, round(sum(usage_kwh), 4) AS kwh, "
    "count(*) AS intervals FROM energy GROUP BY 1",
    "energy",
)
def _(spark, sf):
    return shifts.shift_totals(t.energy(spark, sf)).select("shift_code", _r("kwh", 4), "intervals")


@query(
    "busiest_shift",
    f"SELECT {_SHIFT.format('ts')} AS shift_code FROM energy GROUP BY 1 "
    "ORDER BY sum(usage_kwh) DESC LIMIT 1",
    "energy",
)
def _(spark, sf):
    return shifts.busiest_shift(t.energy(spark, sf))


@query(
    "energy_by_load_type",
    "SELECT load_type, count(*) AS nb_intervalles, CAST(round(CAST(sum(usage_kwh) AS "
    "DECIMAL(38,10)), 1) AS DOUBLE) AS total_kwh, CAST(round(CAST(sum(co2_tco2) AS DECIMAL(38,10)), "
    "3) AS DOUBLE) AS total_tco2, CAST(round(CAST(avg(usage_kwh) AS DECIMAL(38,10)), 2) AS DOUBLE) "
    "AS moyenne_kwh FROM energy GROUP BY load_type",
    "energy",
)
def _(spark, sf):
    return energy.energy_by_load_type(t.energy(spark, sf))


@query(
    "peak_energy_intervals",
    f"SELECT {ts('ts')} AS ts, usage_kwh, load_type, lagging_current_power_factor FROM energy "
    "WHERE usage_kwh > 99.0",
    "energy",
)
def _(spark, sf):
    return energy.peak_energy_intervals(t.energy(spark, sf))


# ---- maintenance ----


@query(
    "mttr",
    "SELECT round(avg(downtime_minutes) FILTER (WHERE category = 'corrective'), 6) AS mttr_minutes "
    "FROM maintenance",
    "maintenance",
)
def _(spark, sf):
    return maintenance.mttr_total(t.maintenance(spark, sf)).select(_r("mttr_minutes"))


@query(
    "mtbf",
    "SELECT round(43200.0 / count(*) FILTER (WHERE category = 'corrective'), 6) AS mtbf_minutes "
    "FROM maintenance",
    "maintenance",
)
def _(spark, sf):
    return maintenance.mtbf_total(t.maintenance(spark, sf), 43200).select(_r("mtbf_minutes"))


_BY_LINE = (
    "SELECT line_id, avg(downtime_minutes) FILTER (WHERE category = 'corrective') AS mttr_minutes, "
    "43200.0 / nullif(count(*) FILTER (WHERE category = 'corrective'), 0) AS mtbf_minutes, count(*) "
    "AS events, CAST(sum(downtime_minutes) AS BIGINT) AS downtime_minutes FROM {0} GROUP BY line_id"
)


@query(
    "maintenance_by_line",
    "SELECT line_id, round(mttr_minutes, 6) AS mttr_minutes, round(mtbf_minutes, 6) AS "
    f"mtbf_minutes, events, downtime_minutes FROM ({_BY_LINE.format('maintenance')})",
    "maintenance",
)
def _(spark, sf):
    events = t.maintenance(spark, sf)
    return _rounded(maintenance.maintenance_by_line(events, maintenance.operating_minutes(events)))


@query(
    "operating_minutes",
    "SELECT DISTINCT line_id, CAST(43200 AS BIGINT) AS operating_minutes FROM maintenance",
    "maintenance",
)
def _(spark, sf):
    return maintenance.operating_minutes(t.maintenance(spark, sf))


def _oee_periods(spark, sf):
    """Per month with plates: 93 shifts planned, corrective downtime (none where no event is), plates
    made and rejected."""
    month = calendar.month_start
    downtime = t.maintenance(spark, sf).groupBy(month(F.col("started_at")).alias("period")).agg(
        (F.sum("downtime_minutes") / 100).alias("downtime_minutes")
    )
    made = t.plates(spark, sf).groupBy(month(F.col("inspected_at")).alias("period")).agg(
        F.count("*").alias("plates"), F.count_if(F.col("steel_grade") == "R").alias("rejected")
    )
    planned = maintenance.planned_minutes(F.lit(93))
    joined = made.join(downtime, "period", "left").withColumn("planned_minutes", planned)
    stopped = F.coalesce("downtime_minutes", F.lit(0).cast(joined.schema["downtime_minutes"].dataType))
    return joined.withColumn("downtime_minutes", stopped)


_OEE = f"""SELECT {_month('period')} AS period, round(a, 6) AS availability,
    round(p, 6) AS performance, round(q, 6) AS quality, round(a * p * q, 6) AS oee FROM (
    SELECT period, greatest(44640 - d, 0) / 44640.0 AS a,
    CASE WHEN 44640 - d > 0 THEN least(n / ((44640 - d) / 60.0) / 42, 1.0) ELSE 0.0 END AS p,
    (n - r) / CAST(n AS DOUBLE) AS q FROM (SELECT period, n, r, coalesce(d, 0) AS d FROM
    (SELECT date_trunc('month', inspected_at) AS period, count(*) AS n,
     count(*) FILTER (WHERE steel_grade = 'R') AS r FROM plates GROUP BY 1) LEFT JOIN
    (SELECT date_trunc('month', started_at) AS period, sum(downtime_minutes) / 100.0 AS d
     FROM maintenance GROUP BY 1) USING (period)))"""


@query("oee_components", _OEE.replace(", round(a * p * q, 6) AS oee", ""), "maintenance", "plates")
def _(spark, sf):
    found = maintenance.oee_by_line(_oee_periods(spark, sf))
    return _rounded(found.select("period", "availability", "performance", "quality"))


@query("oee", _OEE, "maintenance", "plates")
def _(spark, sf):
    found = maintenance.oee_by_line(_oee_periods(spark, sf))
    return _rounded(found.select("period", "availability", "performance", "quality", "oee"))


def _stops(spark, sf):
    """Stops of up to three and a half days that begin at any minute: many run into each other."""
    start = F.col("started_at") + F.make_dt_interval(mins=(F.col("event_id") % 1440).cast("int"))
    return t.maintenance(spark, sf).join(
        t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), "o_totalprice"), "event_id"
    ).select("line_id", start.alias("started_at"), (
        start + F.make_dt_interval(mins=F.floor(F.col("o_totalprice") / 100).cast("int"))).alias("ended_at"))


@query(
    "distinct_stops",
    f"""WITH stops AS (
      SELECT o_orderpriority AS line_id, o_orderdate + to_minutes(o_orderkey % 1440) AS s,
        o_orderdate + to_minutes(o_orderkey % 1440) + to_minutes(CAST(floor(o_totalprice / 100) AS BIGINT)) AS e FROM orders),
    begun AS (
      SELECT *, coalesce(s > max(e) OVER (PARTITION BY line_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM stops),
    islands AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM begun),
    merged AS (SELECT line_id, min(s) AS s, max(e) AS e FROM islands GROUP BY line_id, island),
    months AS (SELECT unnest(generate_series(date_trunc('month', (SELECT min(s) FROM stops)), (SELECT max(e) FROM stops), INTERVAL 1 MONTH)) AS m),
    parts AS (
      SELECT line_id, m, date_diff('microsecond', greatest(s, m), least(e, m + INTERVAL 1 MONTH)) / 60000000 AS minutes
      FROM merged JOIN months ON s < m + INTERVAL 1 MONTH AND e > m)
    SELECT line_id, {_month('m')} AS period, round(sum(minutes), 6) AS stop_minutes,
      round(greatest(44640 - sum(minutes), 0) / 44640, 6) AS availability FROM parts GROUP BY 1, 2""",
)
def _(spark, sf):
    found = maintenance.distinct_stops(_stops(spark, sf))
    planned = maintenance.planned_minutes(F.lit(93))
    return _rounded(found.withColumn("availability", indicators.availability(planned, F.col("stop_minutes"))))


@query(
    "monthly_report",
    f"""SELECT section, key, metric, round(value, 6) AS value FROM (
    WITH e AS (SELECT * FROM maintenance WHERE started_at >= '1998-03-01' AND started_at < '1998-04-01'),
    i AS (SELECT * FROM plates WHERE inspected_at >= '1998-03-01' AND inspected_at < '1998-04-01'),
    r AS (SELECT o_orderdate AS ts, o_totalprice / 1000 AS usage_kwh, o_totalprice / 1000000 AS co2_tco2
          FROM orders WHERE o_orderdate >= '1998-03-01' AND o_orderdate < '1998-04-01'),
    by_line AS ({_BY_LINE.format('e')}),
    k AS (SELECT sum(usage_kwh) AS kwh, sum(co2_tco2) AS co2, count(*) FILTER (WHERE usage_kwh > 99.0)
          AS peaks, (SELECT count(*) FROM i) AS plates FROM r)
    SELECT 'energy' AS section, 'all' AS key, 'total_kwh' AS metric, kwh AS value FROM k
    UNION ALL SELECT 'energy', 'all', 'co2_kg_per_kwh', co2 * 1000 / kwh FROM k
    UNION ALL SELECT 'energy', 'all', 'intensity_kwh_per_plate', kwh / plates FROM k
    UNION ALL SELECT 'energy', 'all', 'peak_intervals', peaks FROM k
    UNION ALL SELECT 'shifts', {_SHIFT.format('ts')}, 'kwh', sum(usage_kwh) FROM r GROUP BY 2
    UNION ALL SELECT 'shifts', {_SHIFT.format('ts')}, 'intervals', count(*) FROM r GROUP BY 2
    UNION ALL SELECT 'quality', 'all', 'inspections', count(*) FROM i
    UNION ALL SELECT 'quality.faults', CAST(fault_code AS VARCHAR), 'count', count(*) FROM i GROUP BY 2
    UNION ALL SELECT 'maintenance.by_line', line_id, 'mttr_minutes', mttr_minutes FROM by_line
    UNION ALL SELECT 'maintenance.by_line', line_id, 'mtbf_minutes', mtbf_minutes FROM by_line
    UNION ALL SELECT 'maintenance.by_line', line_id, 'events', events FROM by_line
    UNION ALL SELECT 'maintenance.by_line', line_id, 'downtime_minutes', downtime_minutes FROM by_line
    UNION ALL SELECT * FROM (SELECT 'maintenance.top_faults', CAST(fault_code AS VARCHAR), 'minutes',
      sum(downtime_minutes) AS m FROM e WHERE fault_code IS NOT NULL GROUP BY fault_code
      ORDER BY m DESC, fault_code LIMIT 5))""",
    "maintenance", "plates",
)
def _(spark, sf):
    readings = t.table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 1000).alias("usage_kwh"),
        (F.col("o_totalprice") / 1000000).alias("co2_tco2"),
    )
    report = reports.monthly_report(
        readings, t.plates(spark, sf), t.maintenance(spark, sf), 1998, 3
    )
    return report.select("section", "key", "metric", _r("value"))


# ---- holds and fault reports ----


@query(
    "hold_duration",
    f"SELECT fault_code, CASE WHEN {_HELD} THEN 72 WHEN severity = 1 THEN 4 WHEN severity = 2 THEN "
    "24 WHEN severity = 3 THEN 72 ELSE 4 END AS hours FROM faults",
    "faults",
)
def _(spark, sf):
    hours = indicators.hold_hours(F.col("label_fr"), F.col("severity"), HELD_LABELS)
    return t.faults(spark, sf).select("fault_code", hours.alias("hours"))


@query(
    "should_hold",
    f"SELECT fault_code, ({_HELD} OR severity >= 2) AS hold FROM faults", "faults",
)
def _(spark, sf):
    hold = indicators.should_hold(F.col("label_fr"), F.col("severity"), HELD_LABELS)
    return t.faults(spark, sf).select("fault_code", hold.alias("hold"))


@query(
    "hold_summary",
    f"SELECT batch_id, count(*) FILTER (WHERE {_HELD} OR severity >= 2) AS held, "
    f"count(*) FILTER (WHERE NOT ({_HELD} OR severity >= 2)) AS released, "
    f"count(*) FILTER (WHERE {_HELD} OR severity >= 3) / CAST(count(*) AS DOUBLE) > 0.08 AS "
    "manual_review FROM plates JOIN faults USING (fault_code) GROUP BY batch_id",
    "plates", "faults",
)
def _(spark, sf):
    joined = t.plates(spark, sf).join(t.faults(spark, sf), "fault_code")
    return quality.hold_summary(joined, "batch_id", fault="label_fr", always_hold=HELD_LABELS)


@query(
    "defect_geometry",
    """SELECT *, coalesce(aspect_ratio >= 4.0 OR aspect_ratio <= 0.25, false) AS elongated FROM (
    SELECT batch_id, x_maximum - x_minimum AS width, y_maximum - y_minimum AS height,
    round((x_maximum - x_minimum) / CAST(nullif(y_maximum - y_minimum, 0) AS DOUBLE), 6) AS aspect_ratio,
    CAST((x_maximum - x_minimum) * (y_maximum - y_minimum) AS BIGINT) AS box_area,
    round(pixels_areas / CAST(nullif((x_maximum - x_minimum) * (y_maximum - y_minimum), 0) AS DOUBLE), 6)
    AS fill_ratio, round(sum_of_luminosity / CAST(nullif(pixels_areas, 0) AS DOUBLE), 6) AS mean_luminosity
    FROM plates)""",
    "plates",
)
def _(spark, sf):
    columns = ("x_minimum", "x_maximum", "y_minimum", "y_maximum", "pixels_areas", "sum_of_luminosity")
    measures = indicators.defect_geometry(*[F.col(c) for c in columns])
    return _rounded(
        t.plates(spark, sf).select("batch_id", *[c.alias(n) for n, c in measures.items()])
    )


@query(
    "fault_counts_by_line",
    "SELECT l.line_id, l.name_fr AS ligne, p.fault_code, f.label_fr AS libelle_defaut, f.severity, "
    "count(*) AS nb_toles FROM plates p JOIN lines l ON l.line_id = p.line_id JOIN faults f ON "
    "f.fault_code = p.fault_code GROUP BY 1, 2, 3, 4, 5",
    "plates", "lines", "faults",
)
def _(spark, sf):
    return quality.fault_counts_by_line(
        t.plates(spark, sf), t.lines(spark, sf), t.faults(spark, sf)
    )


@query(
    "monthly_fault_trend",
    f"SELECT {_month('p.inspected_at')} AS mois, count(*) FILTER (WHERE f.severity = 3) AS "
    "defauts_critiques, count(*) AS defauts_total, CAST(round(CAST(100.0 * count(*) FILTER (WHERE "
    "f.severity = 3) AS DECIMAL(38,6)) / count(*), 2) AS DOUBLE) AS part_critiques_pct "
    "FROM plates p JOIN faults f ON f.fault_code = p.fault_code GROUP BY 1",
    "plates", "faults",
)
def _(spark, sf):
    return quality.monthly_fault_trend(t.plates(spark, sf), t.faults(spark, sf))


@query(
    "downtime_by_fault",
    "SELECT m.fault_code, f.label_fr AS libelle_defaut, count(*) AS nb_interventions, "
    "CAST(sum(m.downtime_minutes) AS BIGINT) AS minutes_arret, round(CAST(sum(m.downtime_minutes) "
    "AS DOUBLE) / count(*), 1) AS moyenne_minutes FROM maintenance m JOIN faults f ON f.fault_code "
    "= m.fault_code WHERE m.category = 'corrective' GROUP BY 1, 2",
    "maintenance", "faults",
)
def _(spark, sf):
    return quality.downtime_by_fault(t.maintenance(spark, sf), t.faults(spark, sf))


@query(
    "plates_on_hold",
    f"SELECT p.batch_id, p.line_id, {ts('p.inspected_at')} AS inspected_at, p.fault_code, "
    f"f.severity FROM plates p JOIN faults f ON f.fault_code = p.fault_code WHERE f.severity >= 2 "
    f"OR f.{_HELD}",
    "plates", "faults",
)
def _(spark, sf):
    return quality.plates_on_hold(
        t.plates(spark, sf), t.faults(spark, sf),
        ["batch_id", "line_id", "inspected_at", "fault_code"],
        always_hold=HELD_LABELS, fault="label_fr",
    )


# ---- facts behind the documents ----


def _facts(spark, sf):
    return reports.plant_facts(
        t.lines(spark, sf), t.faults(spark, sf),
        _shift_table(spark, sf), t.plates(spark, sf), t.maintenance(spark, sf), t.energy(spark, sf),
    )


def _shift_table(spark, sf):
    from lamina.sources.files import seed_dims

    return seed_dims(spark)["shifts"]


@query(
    "plant_facts_faults",
    "SELECT f.fault_code, f.label_fr, f.label_en, f.severity, f.procedure_doc_id, "
    "count(p.fault_code) AS plate_count FROM faults f LEFT JOIN plates p ON p.fault_code = "
    "f.fault_code GROUP BY 1, 2, 3, 4, 5",
    "faults", "plates",
)
def _(spark, sf):
    return _facts(spark, sf)["faults"]


@query(
    "plant_facts_lines", "SELECT line_id, name_fr, name_en, process, commissioned_year FROM lines",
    "lines",
)
def _(spark, sf):
    return _facts(spark, sf)["lines"]


@query(
    "plant_facts_reports",
    f"SELECT m.event_id, m.line_id, {ts('m.started_at')} AS started_at, {ts('m.ended_at')} AS "
    "ended_at, m.downtime_minutes, m.category, m.fault_code, m.report_doc_id, f.label_fr AS "
    "fault_label_fr, f.severity FROM maintenance m LEFT JOIN faults f ON f.fault_code = "
    "m.fault_code WHERE m.report_doc_id IS NOT NULL",
    "maintenance", "faults",
)
def _(spark, sf):
    return _facts(spark, sf)["reports"]


@query(
    "plant_facts_line_stats",
    "SELECT DISTINCT ON (line_id) line_id, CAST(sum(n) OVER (PARTITION BY line_id) AS BIGINT) AS "
    "plates, fault_code AS top_fault FROM (SELECT line_id, fault_code, count(*) AS n FROM plates "
    "GROUP BY 1, 2) ORDER BY line_id, n DESC, fault_code",
    "plates",
)
def _(spark, sf):
    return _facts(spark, sf)["line_stats"]


@query(
    "plant_facts_top_line_by_fault",
    "SELECT DISTINCT ON (fault_code) fault_code, line_id, n FROM (SELECT fault_code, line_id, "
    "count(*) AS n FROM plates GROUP BY 1, 2) ORDER BY fault_code, n DESC, line_id",
    "plates",
)
def _(spark, sf):
    return _facts(spark, sf)["top_line_by_fault"]


@query(
    "plant_facts_peak_threshold",
    "SELECT CAST(0.95 AS DOUBLE) AS fraction, round(quantile_cont(usage_kwh, 0.95), 6) AS "
    "percentile FROM energy",
    "energy",
)
def _(spark, sf):
    return _rounded(_facts(spark, sf)["peak_threshold"])


@query(
    "plant_facts_energy",
    "SELECT CAST(round(CAST(sum(usage_kwh) AS DECIMAL(38,10)), 1) AS DOUBLE) AS total_kwh, "
    "CAST(round(CAST(sum(co2_tco2) AS DECIMAL(38,10)), 2) AS DOUBLE) AS total_tco2, "
    "CAST(round(CAST(max(usage_kwh) AS DECIMAL(38,10)), 2) AS DOUBLE) AS max_kwh FROM energy",
    "energy",
)
def _(spark, sf):
    return _facts(spark, sf)["energy"]


@query(
    "plant_facts",
    """SELECT 'faults' AS fact, CAST(f.fault_code AS VARCHAR) AS key, CAST(count(p.fault_code) AS DOUBLE) AS value
      FROM faults f LEFT JOIN plates p ON p.fault_code = f.fault_code GROUP BY 2
    UNION ALL SELECT 'lines', CAST(line_id AS VARCHAR), commissioned_year FROM lines
    UNION ALL SELECT 'reports', CAST(event_id AS VARCHAR), downtime_minutes FROM maintenance
      WHERE report_doc_id IS NOT NULL
    UNION ALL SELECT 'shifts', code, start FROM (VALUES ('M', 6), ('A', 14), ('N', 22)) AS v(code, start)
    UNION ALL SELECT 'top_line_by_fault', CAST(fault_code AS VARCHAR), line_id FROM ranked WHERE by_fault = 1
    UNION ALL SELECT 'line_stats', CAST(line_id AS VARCHAR), sum(n) FROM ranked GROUP BY 2
    UNION ALL SELECT 'peak_threshold', 'p95', round(quantile_cont(usage_kwh, 0.95), 6) FROM energy
    UNION ALL SELECT 'energy', 'total_kwh', round(CAST(sum(usage_kwh) AS DECIMAL(38,10)), 1) FROM energy
    """.replace("FROM ranked", "FROM (SELECT *, row_number() OVER (PARTITION BY fault_code ORDER BY n DESC, "
                "line_id) AS by_fault FROM (SELECT fault_code, line_id, count(*) AS n FROM plates GROUP BY 1, 2))"),
    "faults", "plates", "lines", "maintenance", "energy",
)
def _(spark, sf):
    facts = _facts(spark, sf)
    shown = {
        "faults": ("fault_code", "plate_count"), "lines": ("line_id", "commissioned_year"),
        "reports": ("event_id", "downtime_minutes"), "shifts": ("shift_code", "start_hour"),
        "top_line_by_fault": ("fault_code", "line_id"), "line_stats": ("line_id", "plates"),
        "peak_threshold": (None, "percentile"), "energy": (None, "total_kwh"),
    }
    labels = {"peak_threshold": "p95", "energy": "total_kwh"}
    parts = [
        facts[name].select(
            F.lit(name).alias("fact"),
            (F.col(key).cast("string") if key else F.lit(labels[name])).alias("key"),
            F.round(F.col(value).cast("double"), 6).alias("value"),
        )
        for name, (key, value) in shown.items()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged
