"""The given tables in the roles the operators expect, for Spark and as oracle SQL.

Every adapter keeps all rows. The SQL text of an adapter is the same mapping for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.sources.files import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for costly per-row work such as regular expressions or Python."""
    return spread(table(spark, sf_dir, name))


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings: one event is one interval, ``props.k`` plays the power factor."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts",
        F.col("value").alias("usage_kwh"),
        F.round(F.col("value") * k / 100.0, 4).alias("lagging_current_reactive_power_kvarh"),
        (F.col("value") * 0.0005).alias("co2_tco2"),
        k.alias("lagging_current_power_factor"),
        F.when(F.dayofweek("ts").isin(1, 7), "Weekend").otherwise("Weekday").alias("week_status"),
        F.col("event_type").alias("load_type"),
    )


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspections: one lineitem is one plate."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("batch_id"),
        F.col("l_suppkey").alias("line_id"),
        F.col("l_shipdate").alias("inspected_at"),
        F.col("l_returnflag").alias("steel_grade"),
        F.col("l_partkey").alias("fault_code"),
        F.col("l_linenumber").alias("x_minimum"),
        (F.col("l_linenumber") + F.col("l_quantity").cast("int")).alias("x_maximum"),
        F.lit(0).cast("bigint").alias("y_minimum"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("y_maximum"),
        F.round(F.col("l_tax") * 100).cast("int").alias("pixels_areas"),
        F.floor("l_extendedprice").cast("bigint").alias("sum_of_luminosity"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production lines: suppliers with their nation as the process."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("line_id"), F.col("s_name").alias("name_fr"),
        F.col("n_name").alias("name_en"), F.col("n_name").alias("process"),
        (F.lit(1990) + F.col("n_nationkey")).alias("commissioned_year"),
    )


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fault types: parts, with a severity from 1 to 3."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("fault_code"), F.col("p_type").alias("label_fr"),
        F.col("p_brand").alias("label_en"), (F.col("p_size") % 3 + 1).alias("severity"),
        F.concat(F.lit("PROC-"), F.col("p_partkey")).alias("procedure_doc_id"),
    )


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maintenance events: orders; status P is preventive and carries no fault."""
    minutes = F.col("o_totalprice") / 1000
    ended = F.col("o_orderdate") + F.make_dt_interval(mins=F.floor(minutes).cast("int"))
    preventive = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("line_id"),
        F.col("o_orderdate").alias("started_at"), ended.alias("ended_at"),
        F.round(minutes).cast("int").alias("downtime_minutes"),
        F.when(preventive, "preventive").otherwise("corrective").alias("category"),
        F.when(~preventive, F.col("o_custkey") * 2).alias("fault_code"),
        F.when(
            F.col("o_totalprice") > 450000, F.concat(F.lit("MNT-RPT-"), F.col("o_orderkey"))
        ).alias("report_doc_id"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus chunks: one document is one chunk below its source and language."""
    return spread_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.lit("doc").alias("source_type"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("source_id"),
        F.concat_ws(" > ", "source", "lang").alias("section"),
        F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"),
        F.col("text").alias("content"), F.col("source").alias("title"),
        F.concat_ws(" ", "source", "lang").alias("heading"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries: every benchmark passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows of runs: labelled documents, their source as the configuration."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    n = F.col("n_chars")
    tools = F.array(F.lit("sql_query"), F.lit("search_docs"))
    return joined.select(
        F.col("source").alias("config"), F.col("doc_id").alias("id"),
        F.when(F.col("lang") == "es", "unanswerable").otherwise(F.col("lang")).alias("category"),
        "lang",
        F.slice(tools, 1, (n % 3).cast("int")).alias("tools_called"),
        F.slice(tools, 1, (F.col("doc_id") % 3).cast("int")).alias("expected_tools"),
        F.when(F.col("lang") != "de", F.concat(F.lit("SELECT "), "n_chars")).alias("sql_generated"),
        F.when(F.col("lang") != "de", F.col("quality") == 1).alias("sql_valid"),
        F.when(F.col("lang") != "de", (F.col("quality") == 1) & (n % 2 == 0)).alias("sql_correct"),
        F.when(F.col("lang") != "fr", (n % 4 != 0).cast("double")).alias("retrieval_hit"),
        F.when(n % 7 != 0, (n % 5 + 1).cast("double")).alias("faithfulness"),
        F.when(n % 11 != 0, (n % 4 + 1).cast("double")).alias("answer_correctness"),
        (F.col("toxic") == 1).alias("refused"),
        (n % 6).cast("int").alias("numbers_checked"),
        F.least(n % 6, F.col("doc_id") % 6).cast("int").alias("numbers_grounded"),
        F.when(n % 13 == 0, 0).otherwise(n).cast("int").alias("latency_ms"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("Désolé. "), F.col("text")))
        .otherwise(F.col("text")).alias("answer"),
        F.when(n % 50 == 0, "timeout").alias("error"),
    )


def grounding_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One French answer per order about its lines."""
    from lamina.functions.numbers import fr_number

    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max("l_extendedprice").alias("top"), F.count("*").alias("n"),
        F.round(F.sum("l_quantity"), 0).alias("quantity"),
    )
    return grouped.select(
        "id",
        F.concat(
            F.lit("Le prix maximal est de "), fr_number(F.col("top"), 2), F.lit(" pour "),
            F.col("n").cast("string"), F.lit(" lignes et "),
            fr_number(F.col("quantity"), 0), F.lit(" pièces."),
        ).alias("answer"),
    )


def grounding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool output per line of an order."""
    return spread_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.concat(
            F.lit("quantity "), F.col("l_quantity").cast("int").cast("string"), F.lit(" price "),
            F.col("l_extendedprice").cast("decimal(12,2)").cast("string"),
        ).alias("evidence"),
    )


CTE = {
    "energy": """SELECT event_id, user_id, ts, value AS usage_kwh,
        round(value * k / 100.0, 4) AS lagging_current_reactive_power_kvarh,
        value * 0.0005 AS co2_tco2, k AS lagging_current_power_factor,
        CASE WHEN dayofweek(ts) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS week_status,
        event_type AS load_type
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""",
    "plates": """SELECT l_orderkey AS batch_id, l_suppkey AS line_id, l_shipdate AS inspected_at,
        l_returnflag AS steel_grade, l_partkey AS fault_code, l_linenumber AS x_minimum,
        l_linenumber + CAST(l_quantity AS INTEGER) AS x_maximum, 0::BIGINT AS y_minimum,
        CAST(round(l_discount * 100) AS BIGINT) AS y_maximum,
        CAST(round(l_tax * 100) AS INTEGER) AS pixels_areas,
        CAST(floor(l_extendedprice) AS BIGINT) AS sum_of_luminosity FROM lineitem""",
    "lines": """SELECT s_suppkey AS line_id, s_name AS name_fr, n_name AS name_en,
        n_name AS process, 1990 + n_nationkey AS commissioned_year
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "faults": """SELECT p_partkey AS fault_code, p_type AS label_fr, p_brand AS label_en,
        p_size % 3 + 1 AS severity, 'PROC-' || p_partkey AS procedure_doc_id FROM part""",
    "maintenance": """SELECT o_orderkey AS event_id, o_orderpriority AS line_id,
        o_orderdate AS started_at,
        o_orderdate + to_minutes(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS ended_at,
        CAST(round(o_totalprice / 1000) AS INTEGER) AS downtime_minutes,
        CASE WHEN o_orderstatus = 'P' THEN 'preventive' ELSE 'corrective' END AS category,
        CASE WHEN o_orderstatus <> 'P' THEN o_custkey * 2 END AS fault_code,
        CASE WHEN o_totalprice > 450000 THEN 'MNT-RPT-' || o_orderkey END AS report_doc_id
        FROM orders""",
    "chunks": """SELECT doc_id AS chunk_id, 'doc-' || doc_id AS source_id,
        source || ' > ' || lang AS section, text AS content, source AS title,
        source || ' ' || lang AS heading, lang, source FROM documents""",
    "outcomes": """SELECT source AS config, d.doc_id AS id,
        CASE WHEN lang = 'es' THEN 'unanswerable' ELSE lang END AS category, lang,
        (['sql_query', 'search_docs'])[1:(n_chars % 3)] AS tools_called,
        (['sql_query', 'search_docs'])[1:(d.doc_id % 3)] AS expected_tools,
        CASE WHEN lang <> 'de' THEN 'SELECT ' || n_chars END AS sql_generated,
        CASE WHEN lang <> 'de' THEN quality = 1 END AS sql_valid,
        CASE WHEN lang <> 'de' THEN quality = 1 AND n_chars % 2 = 0 END AS sql_correct,
        CASE WHEN lang <> 'fr' THEN CAST(n_chars % 4 <> 0 AS DOUBLE) END AS retrieval_hit,
        CASE WHEN n_chars % 7 <> 0 THEN CAST(n_chars % 5 + 1 AS DOUBLE) END AS faithfulness,
        CASE WHEN n_chars % 11 <> 0 THEN CAST(n_chars % 4 + 1 AS DOUBLE) END AS answer_correctness,
        toxic = 1 AS refused, n_chars % 6 AS numbers_checked,
        least(n_chars % 6, d.doc_id % 6) AS numbers_grounded,
        CASE WHEN n_chars % 13 = 0 THEN 0 ELSE n_chars END AS latency_ms,
        CASE WHEN toxic = 1 THEN 'Désolé. ' || text ELSE text END AS answer,
        CASE WHEN n_chars % 50 = 0 THEN 'timeout' END AS error
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}


def oracle(sql: str, *names: str) -> str:
    """Oracle text over the named adapters."""
    parts = [f"{name} AS ({CTE[name]})" for name in names]
    return (f"WITH {', '.join(parts)} " if parts else "") + sql


def shown(df: DataFrame) -> DataFrame:
    """Instants and dates as text, so that both engines hand over the same values."""
    def text(name: str, kind: str):
        if kind in ("timestamp_ntz", "timestamp"):
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
        if kind == "date":
            return F.date_format(name, "yyyy-MM-dd").alias(name)
        if kind.startswith("decimal"):
            return F.col(name).cast("double").alias(name)
        return F.col(name)

    return df.select(*[text(name, kind) for name, kind in df.dtypes])


TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def ts(column: str) -> str:
    """DuckDB text form of an instant, as ``shown`` writes it."""
    return TS.format(column)
