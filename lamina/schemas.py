"""Table schemas, as Spark DDL."""

from __future__ import annotations

from lamina.constants import ENERGY_COLUMNS, PLATE_COLUMNS

_PLATE_INTS = (
    "x_minimum x_maximum pixels_areas x_perimeter y_perimeter minimum_of_luminosity "
    "maximum_of_luminosity length_of_conveyer steel_plate_thickness"
).split()
_PLATE_LONGS = "y_minimum y_maximum sum_of_luminosity".split()


def _plate_type(column: str) -> str:
    if column in _PLATE_INTS:
        return "int"
    return "bigint" if column in _PLATE_LONGS else "double"


ENERGY_TYPES = {
    column: {"ts": "timestamp_ntz", "nsm": "int", "week_status": "string", "day_of_week": "string",
             "load_type": "string"}.get(column, "double")
    for column in ENERGY_COLUMNS.values()
}
PLATE_TYPES = {column: _plate_type(column) for column in PLATE_COLUMNS.values()}

ENERGY_READINGS = ", ".join(f"{name} {kind}" for name, kind in ENERGY_TYPES.items())
PLATE_INSPECTIONS = (
    "plate_id bigint, line_id string, inspected_at timestamp_ntz, steel_grade string, "
    "fault_code string, " + ", ".join(f"{name} {kind}" for name, kind in PLATE_TYPES.items())
)
MAINTENANCE_EVENTS = (
    "event_id int, line_id string, started_at timestamp_ntz, ended_at timestamp_ntz, "
    "downtime_minutes int, category string, fault_code string, report_doc_id string"
)
FAULT_TYPES = (
    "fault_code string, label_fr string, label_en string, severity int, procedure_doc_id string"
)
PRODUCTION_LINES = (
    "line_id string, name_fr string, name_en string, process string, commissioned_year int"
)
SHIFTS = "shift_code string, label_fr string, label_en string, start_hour int, end_hour int"
CHUNKS = (
    "chunk_id bigint, source_type string, source_id string, section string, start_line int, "
    "end_line int, content string, metadata map<string,string>, source_hash string"
)
QUESTIONS = (
    "id string, lang string, category string, question string, expected_tools array<string>, "
    "gold_sql string, gold_answer string, gold_sources array<string>"
)
EXAMPLES = "question string, sql string"
OUTCOMES = (
    "config string, id string, category string, lang string, tools_called array<string>, "
    "expected_tools array<string>, sql_generated string, sql_valid boolean, sql_correct boolean, "
    "retrieval_hit double, faithfulness double, answer_correctness double, refused boolean, "
    "numbers_checked int, numbers_grounded int, latency_ms int, answer string, error string"
)
REQUEST_LOG = (
    "trace_id string, session_id string, asked_at timestamp, question string, language string, "
    "agent_mode string, tools_used array<string>, latency_ms int, ok boolean, error string"
)
