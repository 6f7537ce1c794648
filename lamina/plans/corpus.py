"""All rules over the document corpus and the tables it refers to, as one report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import quality as dq
from lamina.session import durable


def document_facts(documents: DataFrame, doc_types: Sequence[str]) -> DataFrame:
    """What the rules need to know of each document, written once: ids, problems of its own fields, stated numbers.

    The texts are read here and nowhere else; a row of the result is a few dozen bytes, and of a document about
    an event the numbers it states.
    """
    problems = dq.field_problems(["title", "doc_type"], "body", {"doc_type": doc_types})
    numbers = F.when(F.col("event_id").isNotNull(), dq.stated_numbers(F.coalesce("body", F.lit(""))))
    return durable(documents.select("doc_id", "fault_code", "line_id", "event_id", problems.alias("problems"), numbers.alias("numbers")))


def validate_corpus(
    documents: DataFrame, faults: DataFrame, lines: DataFrame, events: DataFrame,
    doc_types: Sequence[str],
) -> DataFrame:
    """What is wrong with documents, and with their links to faults, lines and events.

    ``documents`` hold doc_id, title, doc_type, body and, where they are about one, fault_code,
    line_id and event_id; ``faults`` fault_code and procedure_doc_id; ``lines`` line_id; ``events``
    event_id, report_doc_id and downtime_minutes (0 or more). No rows: nothing is wrong.
    """
    facts = document_facts(documents, doc_types)
    told = durable(events.select("event_id", "report_doc_id", "downtime_minutes"))
    about = facts.filter(F.col("event_id").isNotNull())
    reports = about.select("doc_id", "numbers", "event_id").join(told, "event_id")
    return dq.union_reports([
        dq.unique_key(facts, ["doc_id"]),
        dq.listed_problems(facts, "doc_id", "problems"),
        dq.foreign_key(facts, "doc_id", "fault_code", faults, "fault_code", "document_fault"),
        dq.foreign_key(facts, "doc_id", "line_id", lines, "line_id", "document_line"),
        dq.foreign_key(faults, "fault_code", "procedure_doc_id", facts, "doc_id", "fault_procedure"),
        dq.bidirectional(told, "report_doc_id", about, "doc_id", "event", "report", "event_report"),
        dq.lists_value(reports, "doc_id", "numbers", "downtime_minutes"),
    ])
