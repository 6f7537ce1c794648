"""Writers: full replace, per-source upsert, append log, gold rows and run files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a run file, in order.
RUN_COLUMNS = (
    "id", "category", "lang", "question", "tools_called", "expected_tools", "sql_generated",
    "sql_valid", "sql_correct", "retrieval_hit", "faithfulness", "answer_correctness", "refused",
    "numbers_checked", "numbers_grounded", "latency_ms", "answer", "error",
)


def sink_replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Idempotent load: whatever was at ``path`` is replaced."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def upsert_by_source(old: DataFrame, new: DataFrame, key: str = "source_id") -> DataFrame:
    """Rows of ``old`` whose source is not in ``new``, plus all of ``new``."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new)


def sink_upsert_by_source(
    spark: SparkSession, old_path: str, new: DataFrame, new_path: str, key: str = "source_id"
) -> DataFrame:
    """Write the merged table as a new version next to the one it was read from."""
    merged = upsert_by_source(spark.read.parquet(old_path), new, key)
    merged.write.mode("overwrite").parquet(new_path)
    return spark.read.parquet(new_path)


def _in_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    return df.withColumns({"buckets": F.lit(buckets), "bucket": bucket})


def sink_buckets(df: DataFrame, path: str, key: str = "source_id", buckets: int = 64) -> None:
    """Create a table for ``sink_upsert_buckets``: folders by number of buckets, then by bucket."""
    _in_buckets(df, key, buckets).write.partitionBy("buckets", "bucket").parquet(path)


def sink_upsert_buckets(
    spark: SparkSession, path: str, new: DataFrame, key: str = "source_id",
    buckets: int | None = None,
) -> None:
    """In-place variant for large tables: only the hash buckets ``new`` touches are rewritten.

    The table is one of ``sink_buckets``, whose folders tell the number of buckets; a different
    ``buckets`` is refused. The rewrite costs as much as the buckets that changed and not as much
    as the table.
    """
    from lamina.session import durable

    old = spark.read.parquet(path)
    stored = sorted(row[0] for row in old.select("buckets").distinct().limit(2).collect())
    if len(stored) != 1 or buckets not in (None, *stored):
        raise ValueError(f"the table at {path} has {stored} buckets, not {buckets}")
    incoming = durable(_in_buckets(new, key, stored[0]))
    touched = old.join(F.broadcast(incoming.select("bucket").distinct()), "bucket", "left_semi")
    merged = durable(upsert_by_source(touched, incoming.select(*touched.columns), key))
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("buckets", "bucket")
        .parquet(path)
    )


def sink_append_log(df: DataFrame, path: str) -> None:
    """Append request rows."""
    df.write.mode("append").parquet(path)


def gold_rows(results: DataFrame, questions: DataFrame, id_col: str = "id") -> DataFrame:
    """Numbered gold rows per question; a question without any row fails the job.

    ``results`` holds (id, position, row) with ``row`` a struct. One output line per row keeps
    a question with a very long result from becoming a single record.
    """
    joined = questions.select(id_col).distinct().join(results, id_col, "left")
    message = F.concat(F.lit("gold query returned no rows: "), F.col(id_col))
    position = F.when(F.col("position").isNotNull(), F.col("position")).otherwise(
        F.raise_error(message).cast("bigint")
    )
    return joined.select(id_col, position.alias("position"), "row")


def empty_gold(results: DataFrame, questions: DataFrame, id_col: str = "id") -> DataFrame:
    """Questions whose gold query returned nothing, for the report instead of the failure."""
    return questions.select(id_col).distinct().join(results, id_col, "left_anti")


def sink_gold(results: DataFrame, questions: DataFrame, path: str, id_col: str = "id") -> None:
    """Write gold rows as JSON lines."""
    gold_rows(results, questions, id_col).write.mode("overwrite").json(path)


def run_rows(outcomes: DataFrame, answer_chars: int | None = None) -> DataFrame:
    """Outcomes in run-file form: joined lists, one-line answers, True/False.

    Answers are whole unless ``answer_chars`` asks for a cut.
    """
    answer = F.translate("answer", "\n", " ")
    def flag(name: str):
        return F.when(F.col(name), "True").when(~F.col(name), "False").alias(name)

    shown = {
        "tools_called": F.array_join("tools_called", "|").alias("tools_called"),
        "expected_tools": F.array_join("expected_tools", "|").alias("expected_tools"),
        "sql_valid": flag("sql_valid"),
        "sql_correct": flag("sql_correct"),
        "refused": flag("refused"),
        "answer": (answer if answer_chars is None else F.substring(answer, 1, answer_chars)).alias("answer"),
    }
    return outcomes.select("config", *[shown.get(c, F.col(c)) for c in RUN_COLUMNS])


def sink_run_csv(
    outcomes: DataFrame, path: str, stamp: str, answer_chars: int | None = None
) -> None:
    """Scored rows of a run below ``run=<stamp>``, one folder per configuration."""
    (
        run_rows(outcomes, answer_chars)
        .write.mode("overwrite")
        .partitionBy("config")
        .csv(
            f"{path}/run={stamp}", header=True, escape='"', emptyValue="", nullValue="",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    )
