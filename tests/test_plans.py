from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamina.operators import quality as dq
from lamina.plans import energy, maintenance, quality, reports, shifts
from lamina.sources.files import seed_dims
from tests.conftest import rows


@pytest.fixture(scope="module")
def readings(spark):
    data = [
        (datetime(2018, 3, 1, 5, 45), 100.0, 10.0, 0.05, 89.0, "Light_Load"),
        (datetime(2018, 3, 1, 6, 0), 99.0, 20.0, 0.05, 90.0, "Light_Load"),
        (datetime(2018, 3, 1, 22, 0), 50.0, 0.0, 0.02, 92.0, "Maximum_Load"),
        (datetime(2019, 3, 2, 0, 0), 1.0, 0.0, 0.0, 91.9, "Maximum_Load"),
        (datetime(2018, 4, 1, 14, 0), 0.0, 0.0, 0.0, 99.0, "Medium_Load"),
    ]
    return spark.createDataFrame(
        data, "ts timestamp_ntz, usage_kwh double, lagging_current_reactive_power_kvarh double, co2_tco2 double, "
        "lagging_current_power_factor double, load_type string",
    )


@pytest.fixture(scope="module")
def events(spark):
    data = [
        (1, "L1", datetime(2018, 3, 1), datetime(2018, 3, 1, 1), 60, "corrective", "Bumps", None),
        (2, "L1", datetime(2018, 3, 2), datetime(2018, 3, 2, 2), 121, "corrective", "Stains", None),
        (3, "L1", datetime(2018, 3, 3), datetime(2018, 3, 3, 1), 60, "preventive", None, None),
        (4, "L2", datetime(2018, 3, 4), datetime(2018, 3, 4, 1), 60, "preventive", "Bumps", "R-4"),
    ]
    return spark.createDataFrame(
        data, "event_id int, line_id string, started_at timestamp_ntz, ended_at timestamp_ntz, downtime_minutes int, "
        "category string, fault_code string, report_doc_id string",
    )


def test_thresholds_are_strict(readings):
    assert energy.peak_intervals(readings).count() == 1
    assert rows(energy.penalty_hours(readings)) == [(0.25,)]
    assert [r[1] for r in rows(energy.worst_intervals(readings, 2), "ts", "power_factor")] == [89.0, 90.0]
    assert energy.poor_power_factor(readings).count() == 3


def test_monthly_summary_merges_years_and_tolerates_missing_plates(spark, readings):
    plates = spark.createDataFrame([(3, 10)], "month int, plates bigint")
    found = {r["month"]: r for r in energy.monthly_summary(readings, plates).collect()}
    assert (found[3]["kwh"], found[3]["intensity"]) == (250.0, 25.0)
    assert found[3]["co2_kg_per_kwh"] == pytest.approx(0.12 * 1000 / 250)
    assert (found[4]["co2_kg_per_kwh"], found[4]["intensity"]) == (None, None)


def test_shift_totals(spark, readings):
    assert rows(shifts.shift_totals(readings)) == [("A", 0.0, 1), ("M", 99.0, 1), ("N", 151.0, 3)]
    assert rows(shifts.busiest_shift(readings)) == [("N",)]
    by_range = shifts.join_shift_range(readings, seed_dims(spark)["shifts"], "ts")
    assert by_range.count() == readings.count()
    assert by_range.filter(F.col("shift_code") != shifts.shift_of(F.col("ts"))).count() == 0


def test_completeness(spark):
    grid = spark.sql(
        "SELECT explode(sequence(TIMESTAMP_NTZ '2018-01-01 00:00:00', TIMESTAMP_NTZ '2018-12-31 23:45:00', "
        "INTERVAL 15 MINUTES)) AS ts"
    )
    assert rows(energy.check_completeness(grid, 2018)) == [(35040, 35040, True)]
    holed = grid.filter("ts <> TIMESTAMP_NTZ '2018-06-01 12:00:00'")
    assert rows(energy.check_completeness(holed, 2018)) == [(35040, 35039, False)]
    assert rows(energy.missing_intervals(holed, "2018-01-01 00:00:00", "2018-12-31 23:45:00")) == [(datetime(2018, 6, 1, 12),)]


def test_maintenance_by_line(spark, events):
    operating = spark.createDataFrame([("L1", 1000)], "line_id string, operating_minutes bigint")
    assert rows(maintenance.maintenance_by_line(events, operating)) == [
        ("L1", 90.5, 500.0, 3, 241), ("L2", None, None, 1, 60),
    ]
    assert rows(maintenance.mtbf_total(events.filter("category = 'preventive'"), 10)) == [(None,)]
    # Every category counts towards a fault's downtime.
    assert rows(maintenance.top_faults_by_downtime(events)) == [("Bumps", 120), ("Stains", 121)]


def test_longest_corrective_events_are_flagged(events):
    flagged = maintenance.flag_longest(events, 1)
    assert rows(flagged, "event_id", "report_doc_id") == [(1, None), (2, "MNT-RPT-2"), (3, None), (4, None)]


def test_hold_summary(spark):
    plates = spark.createDataFrame(
        [("b", "Bumps", 1)] * 12 + [("b", "Z_Scratch", 1)] + [("c", "Bumps", 1)] * 11 + [("c", "Bumps", 3)],
        "batch string, fault_code string, severity int",
    )
    # 1 of 13 is below the rate, 1 of 12 above it.
    assert rows(quality.hold_summary(plates, "batch")) == [("b", 1, 12, False), ("c", 1, 11, True)]


def test_monthly_report_sections(readings, events):
    inspections = events.select(F.col("started_at").alias("inspected_at"), "fault_code")
    found = {(r["section"], r["key"], r["metric"]): r["value"] for r in
             reports.monthly_report(readings, inspections, events, 2018, 3).collect()}
    assert found["energy", "all", "total_kwh"] == 249.0
    assert found["energy", "all", "intensity_kwh_per_plate"] == 249.0 / 4
    assert found["maintenance.by_line", "L1", "mtbf_minutes"] == 21600.0
    assert found["maintenance.top_faults", "Stains", "minutes"] == 121.0
    empty = reports.monthly_report(readings, inspections, events, 2017, 1)
    assert ("energy", "all", "co2_kg_per_kwh", None) in rows(empty)


def test_data_quality_report_lists_every_problem(spark, events):
    faults = seed_dims(spark)["fault_types"]
    report = dq.union_reports(
        [
            dq.unique_key(events, ["line_id"]),
            dq.foreign_key(events.withColumn("fault_code", F.lit("Nope")), "event_id", "fault_code", faults, "fault_code"),
            dq.derived_equal(events, "event_id", "downtime_minutes", "started_at", "ended_at"),
            dq.conditional_null(events, "event_id", "category = 'preventive'", "fault_code", True),
            dq.domain(events, "event_id", {"cat": "category IN ('corrective')", "null": "report_doc_id = 'R-4'"}),
            dq.row_counts({"e": events}, {"e": 5}),
            dq.span(events, "e", "started_at", "2018-03-01 00:00:00", "2018-03-04 00:00:00"),
        ]
    )
    found = rows(report, "check", "subject", "ok")
    assert found == sorted(
        [("unique_key", "L1", False), *[("foreign_key", str(i), False) for i in (1, 2, 3, 4)], ("derived_equal", "2", False),
         ("conditional_null", "4", False), ("domain", "3", False), ("domain", "4", False), ("row_counts", "e", False),
         ("span", "e", True)], key=repr,
    )


def test_document_rules(spark):
    docs = spark.createDataFrame(
        [("D1", "T", "policy", "arrêt de 60 minutes", 60), ("D2", None, "memo", " ", 60), ("D3", "T", "policy", "160 minutes", 60)],
        "doc_id string, title string, doc_type string, body string, minutes int",
    )
    problems = dq.required_fields(docs, "doc_id", ["title"], "body", {"doc_type": ["policy"]})
    assert sorted(r["message"] for r in problems.filter("subject = 'D2'").collect()) == [
        "empty body", "missing field 'title'", "unknown doc_type memo",
    ]
    assert problems.count() == 3
    assert rows(dq.states_value(docs, "doc_id", "body", "minutes"), "subject") == [("D2",), ("D3",)]
    policy = spark.createDataFrame([("P", "seuil de 99 kWh, soit 99,04", 99.04)], "id string, t string, v double")
    assert rows(dq.states_decimal(policy, "id", "t", "v", "kWh"), "ok", "message") == [
        (True, "states 99 kWh"), (True, "states 99,04"),
    ]
    both = dq.bidirectional(docs, "doc_id", spark.createDataFrame([("D1",), ("D9",)], "r string"), "r", "document", "event")
    assert rows(both, "subject", "message") == [
        ("D2", "document has no event"), ("D3", "document has no event"), ("D9", "event has no document"),
    ]


def test_corpus_report_reads_texts_once(spark):
    from lamina.operators import quality as dq
    from lamina.plans import corpus

    docs = [
        ("A", "t", "manual", "arrêt de 42 min, puis 7", "F1", 1, 10), ("A", None, "memo", " ", "F9", 9, 11), ("B", "t", "manual", "x42 42.5 -3", None, None, 12),
        ("C", "t", "manual", None, "F1", 1, None), ("D", "t", "manual", "rien", "F1", 1, 13),
    ]
    documents = spark.createDataFrame(docs, "doc_id string, title string, doc_type string, body string, fault_code string, line_id int, event_id int")
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    faults = spark.createDataFrame([("F1", "Z")], "fault_code string, procedure_doc_id string")
    lines = spark.createDataFrame([(1,)], "line_id int")
    events = spark.createDataFrame([(10, "A", 42), (11, None, 5), (12, "Y", 42), (13, None, None)], "event_id int, report_doc_id string, downtime_minutes int")
    watched = documents.mapInArrow(counted, documents.schema)
    found = {tuple(r) for r in corpus.validate_corpus(watched, faults, lines, events, ["manual"]).collect()}
    assert passed.value == len(docs)
    assert found == {
        ("unique_key", "A", False, "occurs 2 times"), ("required_fields", "A", False, "missing field 'title'"), ("required_fields", "A", False, "empty body"),
        ("required_fields", "A", False, "unknown doc_type memo"), ("required_fields", "C", False, "empty body"),
        ("document_fault", "A", False, "fault_code F9 has no target"), ("document_line", "A", False, "line_id 9 has no target"),
        ("fault_procedure", "F1", False, "procedure_doc_id Z has no target"), ("event_report", "Y", False, "event has no report"),
        ("event_report", "B", False, "report has no event"), ("event_report", "D", False, "report has no event"),
        ("text_states_value", "A", False, "does not state 5"),
    }
    # The numbers of a text decide as the search for one number does.
    told = documents.join(events, "event_id").withColumn("numbers", dq.stated_numbers(F.coalesce("body", F.lit(""))))
    assert dq.lists_value(told, "doc_id", "numbers", "downtime_minutes").collect() == dq.states_value(told, "doc_id", "body", "downtime_minutes").collect()
