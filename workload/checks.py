"""Data-quality rules on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.operators import quality as dq
from lamina.plans import corpus
from workload import tables as t
from workload.registry import query


@query(
    "dq_unique_key",
    "SELECT 'unique_key' AS \"check\", CAST(l_orderkey AS VARCHAR) || ',' || l_linenumber AS subject, "
    "false AS ok, 'occurs ' || count(*) || ' times' AS message FROM lineitem "
    "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def _(spark, sf):
    return dq.unique_key(t.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _documents(spark, sf):
    """Documents with front-matter fields, some of them missing or unknown."""
    return t.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("n_chars") > 100, F.col("source")).alias("title"),
        F.when(F.col("lang") == "de", "memo").otherwise("policy").alias("doc_type"),
        F.when(F.col("n_chars") > 60, F.col("text")).otherwise(" ").alias("body"),
    )


@query(
    "dq_required_fields",
    "SELECT 'required_fields' AS \"check\", CAST(doc_id AS VARCHAR) AS subject, false AS ok, message "
    "FROM (SELECT doc_id, 'missing field ''title''' AS message FROM documents WHERE n_chars <= 100 "
    "UNION ALL SELECT doc_id, 'empty body' FROM documents WHERE n_chars <= 60 OR trim(text) = '' "
    "UNION ALL SELECT doc_id, 'unknown doc_type memo' FROM documents WHERE lang = 'de')",
)
def _(spark, sf):
    return dq.required_fields(
        _documents(spark, sf), "doc_id", ["title", "doc_type"], body="body",
        allowed={"doc_type": ["procedure", "manual", "policy"]},
    )


@query(
    "dq_fk",
    "SELECT 'foreign_key' AS \"check\", CAST(event_id AS VARCHAR) AS subject, false AS ok, "
    "'fault_code ' || m.fault_code || ' has no target' AS message FROM maintenance m LEFT JOIN "
    "faults f ON f.fault_code = m.fault_code WHERE m.fault_code IS NOT NULL AND f.fault_code IS NULL",
    "maintenance", "faults",
)
def _(spark, sf):
    return dq.foreign_key(
        t.maintenance(spark, sf), "event_id", "fault_code", t.faults(spark, sf), "fault_code"
    )


@query(
    "dq_bidirectional",
    "SELECT 'bidirectional' AS \"check\", CAST(k AS VARCHAR) AS subject, false AS ok, message FROM "
    "(SELECT k, 'event has no fault' AS message FROM (SELECT fault_code AS k FROM maintenance WHERE "
    "fault_code IS NOT NULL EXCEPT SELECT fault_code FROM faults) UNION ALL SELECT k, "
    "'fault has no event' FROM (SELECT fault_code AS k FROM faults EXCEPT SELECT fault_code FROM "
    "maintenance))",
    "maintenance", "faults",
)
def _(spark, sf):
    return dq.bidirectional(
        t.maintenance(spark, sf), "fault_code", t.faults(spark, sf), "fault_code", "event", "fault"
    )


@query(
    "dq_text_states_value",
    "SELECT 'text_states_value' AS \"check\", CAST(event_id AS VARCHAR) AS subject, false AS ok, "
    "'does not state ' || downtime_minutes AS message FROM maintenance WHERE NOT regexp_matches("
    "'Arrêt du ' || strftime(started_at, '%Y-%m-%d') || ', durée ' || "
    "CAST(datediff('minute', started_at, ended_at) AS VARCHAR) || ' minutes', "
    "'\\b' || downtime_minutes || '\\b')",
    "maintenance",
)
def _(spark, sf):
    # The report states the distance of its two instants, which rounding can set apart.
    minutes = F.timestamp_diff("MINUTE", F.col("started_at"), F.col("ended_at"))
    report = F.concat(
        F.lit("Arrêt du "), F.date_format("started_at", "yyyy-MM-dd"), F.lit(", durée "),
        minutes.cast("string"), F.lit(" minutes"),
    )
    reports = t.maintenance(spark, sf).withColumn("content", report)
    return dq.states_value(reports, "event_id", "content", "downtime_minutes")


@query(
    "dq_text_states_decimal",
    "SELECT 'text_states_decimal' AS \"check\", CAST(o_orderkey AS VARCHAR) AS subject, "
    "contains(content, form) AS ok, 'states ' || form AS message FROM (SELECT o_orderkey, "
    "replace(format('{:.2f}', o_totalprice), '.', ',') || ' kWh' AS content, unnest([format('{:.0f}', "
    "round_even(o_totalprice, 0)) || ' kWh', replace(format('{:.2f}', o_totalprice), '.', ',')]) AS form "
    "FROM orders)",
)
def _(spark, sf):
    exact = F.translate(F.format_string("%.2f", F.col("o_totalprice")), ".", ",")
    policies = t.table(spark, sf, "orders").withColumn("content", F.concat(exact, F.lit(" kWh")))
    return dq.states_decimal(policies, "o_orderkey", "content", "o_totalprice", "kWh")


@query(
    "dq_domain",
    "SELECT 'domain' AS \"check\", CAST(event_id AS VARCHAR) AS subject, false AS ok, message FROM "
    "(SELECT event_id, 'category: category = ''corrective''' AS message FROM maintenance WHERE NOT "
    "category = 'corrective' UNION ALL SELECT event_id, 'downtime: downtime_minutes BETWEEN 10 AND "
    "490' FROM maintenance WHERE NOT downtime_minutes BETWEEN 10 AND 490 UNION ALL SELECT event_id, "
    "'order: ended_at >= started_at' FROM maintenance WHERE ended_at < started_at)",
    "maintenance",
)
def _(spark, sf):
    rules = {
        "category": "category = 'corrective'",
        "downtime": "downtime_minutes BETWEEN 10 AND 490",
        "order": "ended_at >= started_at",
    }
    return dq.domain(t.maintenance(spark, sf), "event_id", rules)


@query(
    "dq_derived_equal",
    "SELECT 'derived_equal' AS \"check\", CAST(event_id AS VARCHAR) AS subject, false AS ok, "
    "'stored ' || downtime_minutes || ' min, actual ' || datediff('second', started_at, ended_at) "
    "|| ' s' AS message FROM maintenance WHERE downtime_minutes * 60 <> "
    "datediff('second', started_at, ended_at)",
    "maintenance",
)
def _(spark, sf):
    return dq.derived_equal(
        t.maintenance(spark, sf), "event_id", "downtime_minutes", "started_at", "ended_at"
    )


@query(
    "dq_conditional_null",
    "SELECT 'conditional_null' AS \"check\", CAST(event_id AS VARCHAR) AS subject, false AS ok, "
    "'fault_code must be NULL when category = ''preventive''' AS message FROM maintenance WHERE "
    "category = 'preventive' AND fault_code IS NOT NULL UNION ALL SELECT 'conditional_null', "
    "CAST(event_id AS VARCHAR), false, 'report_doc_id must not be NULL when downtime_minutes > 400' "
    "FROM maintenance WHERE downtime_minutes > 400 AND report_doc_id IS NULL",
    "maintenance",
)
def _(spark, sf):
    events = t.maintenance(spark, sf)
    return dq.union_reports(
        [
            dq.conditional_null(events, "event_id", "category = 'preventive'", "fault_code", True),
            dq.conditional_null(events, "event_id", "downtime_minutes > 400", "report_doc_id", False),
        ]
    )


@query(
    "dq_row_counts",
    "SELECT 'row_counts' AS \"check\", name AS subject, n = want AS ok, n || ' rows, expected ' || "
    "want AS message FROM (SELECT 'region' AS name, count(*) AS n, 5 AS want FROM region UNION ALL "
    "SELECT 'nation', count(*), 25 FROM nation UNION ALL SELECT 'orders', count(*), 35040 FROM orders)",
)
def _(spark, sf):
    expected = {"region": 5, "nation": 25, "orders": 35040}
    return dq.row_counts({name: t.table(spark, sf, name) for name in expected}, expected)


@query(
    "dq_span",
    "SELECT 'span' AS \"check\", 'orders' AS subject, min(o_orderdate) = '1995-01-01' AND "
    "max(o_orderdate) = '2001-12-31' AS ok, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') || "
    "' to ' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS message FROM orders",
)
def _(spark, sf):
    orders = t.table(spark, sf, "orders")
    return dq.span(orders, "orders", "o_orderdate", "1995-01-01 00:00:00", "2001-12-31 00:00:00")


@query(
    "corpus_report",
    """WITH d AS (SELECT 'D' || doc_id AS doc_id, CASE WHEN n_chars > 100 THEN source END AS title,
      CASE WHEN lang = 'de' THEN 'memo' ELSE 'policy' END AS doc_type, text AS body,
      CAST(n_chars % 7 AS VARCHAR) AS fault_code, n_chars % 11 AS line_id,
      CASE WHEN doc_id % 3 = 0 THEN doc_id END AS event_id FROM documents),
    f AS (SELECT CAST(k AS VARCHAR) AS fault_code, 'D' || k * 1000 AS procedure_doc_id FROM range(5) AS r(k)),
    l AS (SELECT k AS line_id FROM range(10) AS r(k)),
    e AS (SELECT doc_id AS event_id, CASE WHEN doc_id % 2 = 0 THEN 'D' || doc_id END AS report_doc_id,
      n_chars AS downtime_minutes FROM documents WHERE doc_id % 3 = 0)
    SELECT 'required_fields' AS "check", doc_id AS subject, false AS ok, 'missing field ''title''' AS message FROM d WHERE title IS NULL
    UNION ALL SELECT 'required_fields', doc_id, false, 'empty body' FROM d WHERE trim(body) = ''
    UNION ALL SELECT 'required_fields', doc_id, false, 'unknown doc_type memo' FROM d WHERE doc_type = 'memo'
    UNION ALL SELECT 'document_fault', doc_id, false, 'fault_code ' || fault_code || ' has no target' FROM d WHERE fault_code NOT IN (SELECT fault_code FROM f)
    UNION ALL SELECT 'document_line', doc_id, false, 'line_id ' || line_id || ' has no target' FROM d WHERE line_id NOT IN (SELECT line_id FROM l)
    UNION ALL SELECT 'fault_procedure', fault_code, false, 'procedure_doc_id ' || procedure_doc_id || ' has no target' FROM f
      WHERE procedure_doc_id NOT IN (SELECT doc_id FROM d)
    UNION ALL SELECT 'event_report', doc_id, false, 'report has no event' FROM d WHERE event_id IS NOT NULL
      AND doc_id NOT IN (SELECT report_doc_id FROM e WHERE report_doc_id IS NOT NULL)
    UNION ALL SELECT 'text_states_value', doc_id, false, 'does not state ' || downtime_minutes FROM d JOIN e USING (event_id)
      WHERE NOT regexp_matches(body, '\\b' || downtime_minutes || '\\b')""",
)
def _(spark, sf):
    documents = t.table(spark, sf, "documents")
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    third = F.col("doc_id") % 3 == 0
    corpus_documents = documents.select(
        name.alias("doc_id"), F.when(F.col("n_chars") > 100, F.col("source")).alias("title"),
        F.when(F.col("lang") == "de", "memo").otherwise("policy").alias("doc_type"), F.col("text").alias("body"),
        (F.col("n_chars") % 7).cast("string").alias("fault_code"), (F.col("n_chars") % 11).alias("line_id"),
        F.when(third, F.col("doc_id")).alias("event_id"),
    )
    faults = spark.range(5).select(
        F.col("id").cast("string").alias("fault_code"), F.concat(F.lit("D"), (F.col("id") * 1000).cast("string")).alias("procedure_doc_id")
    )
    events = documents.filter(third).select(
        F.col("doc_id").alias("event_id"), F.when(F.col("doc_id") % 2 == 0, name).alias("report_doc_id"),
        F.col("n_chars").alias("downtime_minutes"),
    )
    return corpus.validate_corpus(
        corpus_documents, faults, spark.range(10).select(F.col("id").alias("line_id")), events, ["procedure", "manual", "policy"]
    )
