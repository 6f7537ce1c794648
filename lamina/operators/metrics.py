"""Scoring of evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.functions.text import is_refusal
from lamina.operators.aggregates import between_ranks, pooled_ratio
from lamina.operators.relational import top_per_group
from lamina.session import durable

UNANSWERABLE = "unanswerable"
# The metrics, in order of report.
METRICS = (
    "sql_execution_accuracy", "sql_valid_rate", "routing_accuracy", "routing_superset_rate",
    "retrieval_recall", "faithfulness_mean", "faithfulness_at_least_4", "answer_correctness_mean",
    "refusal_accuracy", "false_refusal_rate", "number_grounding", "latency_p50_ms",
    "latency_p95_ms",
)


def tools_match(called: Column, expected: Column) -> Column:
    """The same set of tools."""
    return F.array_sort(F.array_distinct(called)) == F.array_sort(F.array_distinct(expected))


def tools_superset(called: Column, expected: Column) -> Column:
    """Every expected tool was called."""
    return F.size(F.array_except(expected, called)) == 0


def recall_at_k(retrieved: Column, gold: Column, k: int | None = None) -> Column:
    """1.0 when a gold id is among the first ``k`` retrieved; NULL without gold ids."""
    head = retrieved if k is None else F.slice(retrieved, 1, k)
    return F.when(F.size(gold) > 0, F.arrays_overlap(head, gold).cast("double"))


def outcome_scoring(
    questions: DataFrame, answers: DataFrame, comparisons: DataFrame, k: int | None = None
) -> DataFrame:
    """One scored row per answered question.

    ``answers`` holds (id, answer, tools_called, sql_generated, sql_ok, sources); ``comparisons``
    holds (id, matches) for results that were compared with gold. A question with gold SQL whose
    tool never ran, or failed, counts as wrong.
    """
    joined = questions.join(answers, "id").join(comparisons.select("id", "matches"), "id", "left")
    ran = F.col("sql_generated").isNotNull()
    has_gold = F.col("gold_sql").isNotNull()
    correct = F.when(ran & has_gold, F.col("sql_ok") & F.coalesce("matches", F.lit(False)))
    return joined.select(
        "id", "category", "lang", "tools_called", "expected_tools", "sql_generated",
        F.when(ran, F.col("sql_ok")).when(has_gold, F.lit(False)).alias("sql_valid"),
        correct.when(~ran & has_gold, F.lit(False)).alias("sql_correct"),
        recall_at_k(F.col("sources"), F.col("gold_sources"), k).alias("retrieval_hit"),
        is_refusal(F.coalesce("answer", F.lit(""))).alias("refused"),
        "answer",
    )


def metrics_aggregate(outcomes: DataFrame, config: str = "config") -> DataFrame:
    """Thirteen metrics per configuration, over all its rows and per category.

    Routing and false refusals count answerable questions only, refusal accuracy unanswerable
    ones only; latencies of 0 are unknown and left out.

    Outcomes are read once and summed per configuration, category and latency. Both scopes and the percentiles
    come from these sums: a task orders the different latencies, whole milliseconds, of one configuration.
    """
    answerable = F.col("category") != UNANSWERABLE
    called, expected = F.col("tools_called"), F.col("expected_tools")

    def flag(value: Column, condition: Column | None = None) -> Column:
        return (value if condition is None else F.when(condition, value)).cast("double")

    # Every mean as a sum over the rows that have a value.
    means = {
        "sql_execution_accuracy": flag(F.col("sql_correct")),
        "sql_valid_rate": flag(F.col("sql_valid")),
        "routing_accuracy": flag(tools_match(called, expected), answerable),
        "routing_superset_rate": flag(tools_superset(called, expected), answerable),
        "retrieval_recall": F.col("retrieval_hit").cast("double"),
        "faithfulness_mean": F.col("faithfulness").cast("double"),
        "faithfulness_at_least_4": flag(F.col("faithfulness") >= 4),
        "answer_correctness_mean": F.col("answer_correctness").cast("double"),
        "refusal_accuracy": flag(F.col("refused"), ~answerable),
        "false_refusal_rate": flag(F.col("refused"), answerable),
    }
    named = outcomes.select(
        config, "category", "latency_ms", F.col("error").isNotNull().cast("long").alias("_error"),
        "numbers_grounded", "numbers_checked", *[v.alias(f"_{m}") for m, v in means.items()],
    )
    sums = named.groupBy(config, "category", "latency_ms").agg(
        F.count("*").alias("n"), F.sum("_error").alias("n_errors"),
        F.sum("numbers_grounded").alias("_grounded"), F.sum("numbers_checked").alias("_checked"),
        *[f(f"_{m}").alias(f"{name}_{m}") for m in means for name, f in (("_sum", F.sum), ("_of", F.count))],
    )
    clash = F.raise_error(F.lit("a category is named 'overall'")).cast("string")
    category = F.when(F.col("category") == "overall", clash).otherwise(F.col("category"))
    scoped = sums.withColumn("scope", F.explode(F.array(F.lit("overall"), category)))
    scope = W.partitionBy(config, "scope")
    known = F.when(F.col("latency_ms") != 0, F.col("n")).otherwise(0)
    running = scope.orderBy("latency_ms").rowsBetween(W.unboundedPreceding, 0)
    counted = scoped.withColumn("_known", known).withColumns(
        {"_cum": F.sum("_known").over(running), "_all": F.sum("_known").over(scope)})
    value = F.when(F.col("_known") > 0, F.col("latency_ms").cast("double"))

    def percentile(fraction: float, name: str) -> Column:
        position = F.lit(fraction) * (F.col("_all") - 1)
        low = F.floor(position)
        high = F.least(low + 1, F.col("_all") - 1)
        ends = [F.min(F.when(F.col("_cum") > rank, value)) for rank in (low, high)]
        return between_ranks(F.max(position), *ends).alias(name)

    def mean(name: str) -> Column:
        total, of = F.sum(f"_sum_{name}"), F.sum(f"_of_{name}")
        return F.when(of > 0, total / of).alias(name)

    return counted.groupBy(config, "scope").agg(
        F.sum("n").alias("n"), F.sum("n_errors").alias("n_errors"), *[mean(m) for m in means],
        pooled_ratio(F.col("_grounded"), F.col("_checked")).alias("number_grounding"),
        percentile(0.5, "latency_p50_ms"), percentile(0.95, "latency_p95_ms"),
    )


def rescore(outcomes: DataFrame, wall_times: DataFrame) -> DataFrame:
    """Metrics with refusals derived again from the stored answers; wall times are kept."""
    derived = outcomes.withColumn("refused", is_refusal(F.coalesce("answer", F.lit(""))))
    kept = wall_times.select("config", "wall_time_s")
    zero = F.lit(0.0)
    return metrics_aggregate(derived).join(kept, "config", "left").withColumn(
        "wall_time_s", F.coalesce("wall_time_s", zero)
    )


def stratified_sample(
    questions: DataFrame, limit: int, category: str = "category", order: Sequence[str] = ("id",)
) -> DataFrame:
    """The first rows of every category, sharing ``limit`` equally; at least one each."""
    number = F.greatest(F.count_distinct(category), F.lit(1))
    each = questions.agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / number)).alias("_each"))
    # No category gives more than ``limit``; how many it does give is one row that joins later.
    chosen = top_per_group(questions, [category], [F.col(c) for c in order], max(1, limit), rank="_rank")
    return chosen.join(F.broadcast(each), F.col("_rank") <= F.col("_each")).drop("_rank", "_each")


def metric_pivot(summary: DataFrame, configs: Sequence[str] | None = None) -> DataFrame:
    """Metrics as rows and configurations as columns; latencies in seconds, wall time in minutes.

    Without ``configs`` they are looked up in the summary, which is made durable first: it is a few
    rows per configuration and costly to derive twice.
    """
    overall = summary.filter(F.col("scope") == "overall")
    overall = overall if configs else durable(overall)
    shown = {m: F.col(m) for m in METRICS}
    shown["latency_p50_ms"] = F.col("latency_p50_ms") / 1000
    shown["latency_p95_ms"] = F.col("latency_p95_ms") / 1000
    names = {"latency_p50_ms": "latency_p50_s", "latency_p95_ms": "latency_p95_s"}
    if "wall_time_s" in summary.columns:
        shown["wall_time_min"] = F.coalesce("wall_time_s", F.lit(0.0)) / 60
    wide = overall.select("config", *[v.alias(names.get(m, m)) for m, v in shown.items()])
    columns = [c for c in wide.columns if c != "config"]
    long = wide.unpivot("config", columns, "metric", "value")
    pivoted = long.groupBy("metric").pivot("config", list(configs) if configs else None)
    return pivoted.agg(F.first("value"))


def best_config(summary: DataFrame) -> DataFrame:
    """The configuration with the best SQL accuracy, then recall, then grounding."""
    overall = summary.filter(F.col("scope") == "overall")
    order = ("sql_execution_accuracy", "retrieval_recall", "number_grounding")
    score = F.struct(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in order], "config")
    return overall.agg(F.max_by("config", score).alias("config"))


def category_breakdown(summary: DataFrame) -> DataFrame:
    """The per-category table of the best configuration."""
    best = best_config(summary).withColumnRenamed("config", "_best")
    rows = summary.filter(F.col("scope") != "overall")
    return rows.join(F.broadcast(best), F.col("config") == F.col("_best"), "left_semi").select(
        "config", F.col("scope").alias("category"), "n", "sql_execution_accuracy",
        "retrieval_recall", "faithfulness_mean", "number_grounding",
        (F.col("latency_p50_ms") / 1000).alias("latency_p50_s"),
    )
