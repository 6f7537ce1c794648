"""Session construction and durable intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# A Python worker holds two Arrow batches, the one it works on and the next, and four or more workers share an executor.
ARROW_BATCH_LIMIT, ARROW_BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Whole documents travel in Arrow batches: bound them by size, not only by row count.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    ARROW_BATCH_LIMIT: ARROW_BATCH_SIZE,
}


def build_session(app_name: str = "lamina", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were planned for; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Give a session that does not name a limit of its own the one that the operators were planned for.

    The limit is read when rows are asked for, after the operator has returned, so it stays set.
    """
    if spark.conf.get(ARROW_BATCH_LIMIT, None) is None:
        spark.conf.set(ARROW_BATCH_LIMIT, ARROW_BATCH_SIZE)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="lamina-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor cannot change its rows.

    Needed wherever a result depends on how rows happened to be laid out in partitions.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
