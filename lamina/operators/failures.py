"""What went wrong in a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.metrics import UNANSWERABLE
from lamina.operators.relational import first_by

# Failure modes and their explanations, in order of precedence.
EXPLANATIONS = {
    "crash": "the run raised an exception",
    "wrong-sql": "the query ran but returned the wrong result",
    "invalid-sql": "no valid SQL was produced",
    "retrieval-miss": "the gold source was not in the top 5",
    "false-refusal": "an answerable question was declined",
    "missed-refusal": "an out-of-scope question was answered",
    "unfaithful": "the judge found unsupported claims",
    "ungrounded-number": "a number was not found in the tool outputs",
}


def _conditions() -> dict[str, Column]:
    def false(name: str) -> Column:
        return F.coalesce(~F.col(name), F.lit(False))

    unanswerable = F.col("category") == UNANSWERABLE
    return {
        "crash": F.length("error") > 0,
        "wrong-sql": false("sql_correct") & F.coalesce("sql_valid", F.lit(False)),
        "invalid-sql": false("sql_valid"),
        "retrieval-miss": F.col("retrieval_hit") == 0.0,
        "false-refusal": ~unanswerable & F.col("refused"),
        "missed-refusal": unanswerable & false("refused"),
        "unfaithful": F.col("faithfulness") <= 3,
        "ungrounded-number": (F.col("numbers_checked") != 0)
        & (F.col("numbers_grounded") != F.col("numbers_checked")),
    }


def failure_mode() -> Column:
    """The first failure mode that applies to a row; NULL when none does."""
    return F.coalesce(*[F.when(test, name) for name, test in _conditions().items()])


def first_per_mode(outcomes: DataFrame, position: str, limit: int = 5) -> DataFrame:
    """The first failing row of every mode, at most ``limit`` of them in row order."""
    failing = outcomes.withColumn("mode", failure_mode()).filter("mode IS NOT NULL")
    kept = [c for c in outcomes.columns if c != position]
    firsts = first_by(failing, ["mode"], [position], [position, *kept])
    what = F.coalesce(*[F.when(F.col("mode") == m, text) for m, text in EXPLANATIONS.items()])
    return firsts.orderBy(position).limit(limit).withColumn("what", what)


def failure_counts(outcomes: DataFrame) -> DataFrame:
    """Rows per failure, most common first; one row may count under several."""
    test = _conditions()
    wrong = F.coalesce(F.col("sql_valid"), F.lit(True)) & F.coalesce(~F.col("sql_correct"), F.lit(False))
    counted = {
        "run error": test["crash"],
        "no valid SQL": test["invalid-sql"],
        "wrong SQL result": wrong,
        "retrieval miss": test["retrieval-miss"],
        "false refusal": test["false-refusal"],
        "missed refusal": test["missed-refusal"],
    }
    modes = F.array_compact(F.array(*[F.when(cond, name) for name, cond in counted.items()]))
    return (
        outcomes.select(F.explode(modes).alias("mode"))
        .groupBy("mode")
        .agg(F.count("*").alias("questions"))
        .orderBy(F.desc("questions"), "mode")
    )
