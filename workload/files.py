"""Scans and sinks. Each query writes data derived from the given tables and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lamina import schemas
from lamina.constants import ENERGY_COLUMNS
from lamina.session import shared_dir
from lamina.sources import files, sinks, versions
from workload import tables as t
from workload.registry import query
from workload.tables import ts


def _folder(spark, name: str) -> str:
    """A new folder below the one the executors share."""
    return f"{shared_dir(spark)}/lamina-{name}-{uuid.uuid4().hex}"


@query(
    "scan_csv",
    f"""SELECT {ts("date_trunc('minute', ts)")} AS ts, usage_kwh, load_type, week_status,
    lagging_current_reactive_power_kvarh, lagging_current_power_factor,
    CAST(hour(ts) * 3600 + minute(ts) * 60 AS INTEGER) AS nsm FROM energy""",
    "energy",
)
def _(spark, sf):
    readings = t.energy(spark, sf)
    values = {
        "ts": F.date_format("ts", "dd/MM/yyyy HH:mm"),
        "leading_current_reactive_power_kvarh": F.lit(0.0),
        "leading_current_power_factor": F.lit(100.0),
        "nsm": F.hour("ts") * 3600 + F.minute("ts") * 60,
        "day_of_week": F.date_format("ts", "EEEE"),
    }
    raw = readings.select(
        *[values.get(column, F.col(column)).alias(source) for source, column in ENERGY_COLUMNS.items()]
    )
    path = _folder(spark, "energy")
    raw.write.csv(path, header=True)
    return files.scan_energy_csv(spark, path).select(
        "ts", "usage_kwh", "load_type", "week_status", "lagging_current_reactive_power_kvarh",
        "lagging_current_power_factor", "nsm",
    )


@query(
    "scan_jsonl",
    "SELECT 'Q' || doc_id AS id, lang, source AS category, text AS question, "
    "CASE WHEN lang = 'fr' THEN 'sql_query|search_docs' ELSE 'sql_query' END AS tools FROM documents",
)
def _(spark, sf):
    tools = F.when(F.col("lang") == "fr", F.array(F.lit("sql_query"), F.lit("search_docs")))
    rows = t.table(spark, sf, "documents").select(
        F.concat(F.lit("Q"), "doc_id").alias("id"), "lang", F.col("source").alias("category"),
        F.col("text").alias("question"),
        tools.otherwise(F.array(F.lit("sql_query"))).alias("expected_tools"),
    )
    path = _folder(spark, "questions")
    rows.write.json(path)
    read = files.scan_jsonl(spark, path)
    return read.select(
        "id", "lang", "category", "question", F.array_join("expected_tools", "|").alias("tools")
    )


@query(
    "scan_code",
    "SELECT CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents",
)
def _(spark, sf):
    path = _folder(spark, "sources")
    t.table(spark, sf, "documents").select("text").write.text(path)
    whole = files.scan_code(spark, path, [".txt"])
    return whole.agg(F.sum(F.length("text")).alias("chars"))


@query(
    "scan_markdown",
    """SELECT 'D' || doc_id AS doc_id, source AS title, 'policy' AS doc_type,
    regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body,
    substr(sha256('---' || chr(10) || 'doc_id: D' || doc_id || chr(10) || 'title: "' || source || '"' ||
    chr(10) || 'doc_type: policy' || chr(10) || '---' || chr(10) || text), 1, 16) AS source_hash
    FROM documents""",
)
def _(spark, sf):
    front = F.concat(
        F.lit("---\ndoc_id: D"), "doc_id", F.lit('\ntitle: "'), "source",
        F.lit('"\ndoc_type: policy\n---\n'),
    )
    documents = t.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("path"),
        F.concat(front, "text").alias("text"),
    )
    parsed = files.with_front_matter(documents)
    return parsed.select(
        "doc_id", F.col("metadata")["title"].alias("title"),
        F.col("metadata")["doc_type"].alias("doc_type"), "body", "source_hash",
    )


_RUN = """SELECT config, CAST(id AS VARCHAR) AS id, category,
    array_to_string(tools_called, '|') AS tools_called, sql_valid, sql_correct, retrieval_hit,
    faithfulness, refused, CAST(numbers_checked AS INTEGER) AS numbers_checked,
    CAST(latency_ms AS INTEGER) AS latency_ms,
    replace(answer, chr(10), ' ') AS answer, error FROM outcomes"""


def _run(spark, sf):
    return t.outcomes(spark, sf).withColumn("question", F.lit("?"))


def _read_run(spark, path):
    read = files.scan_run_csv(spark, path)
    return read.select(
        "config", "id", "category", F.array_join("tools_called", "|").alias("tools_called"),
        "sql_valid", "sql_correct", "retrieval_hit", "faithfulness", "refused", "numbers_checked",
        "latency_ms", "answer", "error",
    )


@query("scan_run_csv", _RUN, "outcomes")
def _(spark, sf):
    path = _folder(spark, "runs")
    older = _run(spark, sf).withColumn("answer", F.lit("older"))
    sinks.sink_run_csv(older, path, "20260101-000000")
    sinks.sink_run_csv(_run(spark, sf), path, "20260102-000000")
    return _read_run(spark, path)


@query("sink_run_csv", _RUN, "outcomes")
def _(spark, sf):
    path = _folder(spark, "runs")
    sinks.sink_run_csv(_run(spark, sf), path, "20260102-000000")
    return _read_run(spark, path)


@query(
    "seed_dims",
    "SELECT f.code AS fault_code, f.severity, count(*) AS events FROM (VALUES ('view', 'Pastry', 2), "
    "('signup', 'Z_Scratch', 3), ('click', 'Stains', 1), ('error', 'Bumps', 2), ('purchase', "
    "'K_Scratch', 3)) AS f(event_type, code, severity) JOIN events e USING (event_type) GROUP BY 1, 2",
)
def _(spark, sf):
    codes = {"view": "Pastry", "signup": "Z_Scratch", "click": "Stains", "error": "Bumps",
             "purchase": "K_Scratch"}
    code = F.coalesce(*[F.when(F.col("event_type") == e, c) for e, c in codes.items()])
    events = t.table(spark, sf, "events").select(code.alias("fault_code"))
    joined = events.join(files.seed_dims(spark)["fault_types"], "fault_code")
    return joined.groupBy("fault_code", "severity").agg(F.count("*").alias("events"))


@query(
    "sink_replace",
    "SELECT load_type, count(*) AS n FROM energy GROUP BY load_type", "energy",
)
def _(spark, sf):
    path = _folder(spark, "replace")
    readings = t.energy(spark, sf)
    for _round in range(2):
        sinks.sink_replace(readings, path, ["load_type"])
    return spark.read.parquet(path).groupBy("load_type").agg(F.count("*").alias("n"))


@query(
    "sink_append_log",
    "SELECT language, ok, count(*) * 2 AS n FROM (SELECT lang AS language, n_chars > 500 AS ok "
    "FROM documents) GROUP BY 1, 2",
)
def _(spark, sf):
    log = t.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("trace_id"), F.lit(None).cast("string").alias("session_id"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("asked_at"),
        F.col("source").alias("question"), F.col("lang").alias("language"),
        F.lit("router").alias("agent_mode"), F.array(F.lit("sql_query")).alias("tools_used"),
        F.col("n_chars").cast("int").alias("latency_ms"), (F.col("n_chars") > 500).alias("ok"),
        F.lit(None).cast("string").alias("error"),
    )
    path = _folder(spark, "log")
    for _round in range(2):
        sinks.sink_append_log(log, path)
    read = spark.read.schema(schemas.REQUEST_LOG).parquet(path)
    return read.groupBy("language", "ok").agg(F.count("*").alias("n"))


_UPSERT = (
    "SELECT source AS source_id, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE 'old' END AS "
    "version, count(*) AS n FROM documents GROUP BY 1, 2"
)


def _versions(spark, sf):
    old = t.table(spark, sf, "documents").select(
        F.col("source").alias("source_id"), "doc_id", F.lit("old").alias("version")
    )
    changed = old.filter(F.col("source_id").isin("src1", "src2"))
    return old, changed.withColumn("version", F.lit("new"))


def _by_version(df):
    return df.groupBy("source_id", "version").agg(F.count("*").alias("n"))


@query("sink_upsert_by_source", _UPSERT)
def _(spark, sf):
    old, new = _versions(spark, sf)
    path = _folder(spark, "upsert")
    old.write.parquet(f"{path}/v1")
    return _by_version(sinks.sink_upsert_by_source(spark, f"{path}/v1", new, f"{path}/v2"))


@query("sink_upsert_buckets", _UPSERT)
def _(spark, sf):
    old, new = _versions(spark, sf)
    path = _folder(spark, "buckets")
    sinks.sink_buckets(old, path, buckets=8)
    sinks.sink_upsert_buckets(spark, path, new)
    return _by_version(spark.read.parquet(path))


@query("sink_upsert_versioned", _UPSERT)
def _(spark, sf):
    old, new = _versions(spark, sf)
    path = _folder(spark, "versioned")
    versions.create_versioned(old, path, buckets=8)
    versions.upsert_versioned(spark, path, new)
    return _by_version(versions.read_versioned(spark, path))


@query(
    "sink_gold",
    "SELECT CAST(l_suppkey AS VARCHAR) AS id, count(*) AS rows_kept, CAST(sum(n) AS BIGINT) AS n FROM "
    "(SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1",
)
def _(spark, sf):
    counted = t.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count("*").alias("n")
    )
    results = counted.select(
        F.col("l_suppkey").cast("string").alias("id"),
        F.ascii("l_returnflag").cast("bigint").alias("position"),
        F.struct(F.col("l_returnflag").alias("flag"), "n").alias("row"),
    )
    questions = t.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))
    path = _folder(spark, "gold")
    sinks.sink_gold(results, questions, path)
    read = spark.read.schema("id string, position bigint, row struct<flag string, n bigint>").json(path)
    return read.groupBy("id").agg(F.count("*").alias("rows_kept"), F.sum("row.n").alias("n"))
