"""Comparison of results and scoring of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.constants import REFUSAL_MARKERS
from lamina.operators import compare, failures, metrics
from lamina.sources import files, sinks
from workload import tables as t
from workload.answers import _any_of
from workload.files import _folder
from workload.registry import query


def _results(spark, sf):
    """Per supplier, predicted and gold rows of (flag, count, mean price).

    The prediction is off by half a percent for one flag, which is tolerated, and drops returned
    open lines, which is wrong wherever a supplier has any.
    """
    lines = t.table(spark, sf, "lineitem")

    def rows(df, factor):
        return df.groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("flag"),
                          F.col("l_quantity").cast("int").alias("quantity")).agg(
            F.count("*").alias("n"), (F.max("l_extendedprice") * factor).alias("top")
        )

    gold = rows(lines, F.lit(1.0))
    dropped = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") == 7)
    pred = rows(lines.filter(~dropped), F.when(F.col("flag") == "A", 1.005).otherwise(1.0))
    return pred, gold


_RESULTS = """WITH gold AS (SELECT l_suppkey AS id, l_returnflag AS flag, CAST(l_quantity AS INTEGER) AS quantity,
      count(*) AS n, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2, 3),
    pred AS (SELECT l_suppkey AS id, l_returnflag AS flag, CAST(l_quantity AS INTEGER) AS quantity,
      count(*) AS n, max(l_extendedprice) * CASE WHEN l_returnflag = 'A' THEN 1.005 ELSE 1.0 END AS top
      FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity = 7) GROUP BY 1, 2, 3),
    sizes AS (SELECT id, count(*) FILTER (WHERE s = 'p') AS n_pred, count(*) FILTER (WHERE s = 'g') AS n_gold
      FROM (SELECT id, 'p' AS s FROM pred UNION ALL SELECT id, 'g' FROM gold) GROUP BY 1),
    met AS (SELECT coalesce(p.id, g.id) AS id, count(*) FILTER (WHERE p.id IS NULL OR g.id IS NULL OR
      p.n <> g.n OR abs(p.top - g.top) / greatest(p.top, g.top) > 0.01) AS bad
      FROM pred p FULL JOIN gold g ON p.id = g.id AND p.flag = g.flag AND p.quantity = g.quantity GROUP BY 1) """


@query(
    "result_diff",
    _RESULTS + "SELECT id, n_pred, n_gold, n_pred = n_gold AND bad = 0 AS matches FROM sizes JOIN met USING (id)",
)
def _(spark, sf):
    pred, gold = _results(spark, sf)
    return compare.result_diff(pred, gold, by=["id"]).drop("unmatched")


@query(
    "result_diff_ordered",
    _RESULTS + "SELECT id, n_pred, n_gold, bad AS unmatched, n_pred = n_gold AND bad = 0 AS matches "
    "FROM sizes JOIN met USING (id)",
)
def _(spark, sf):
    pred, gold = _results(spark, sf)

    def placed(df):
        place = F.ascii("flag") * 1000 + F.col("quantity")
        return df.select("id", place.alias("position"), "n", "top")

    return compare.result_diff(placed(pred), placed(gold), by=["id"], position="position")


@query(
    "result_diff_floats",
    """WITH p AS (SELECT l_suppkey AS id, l_extendedprice * CASE WHEN l_suppkey % 2 = 0 THEN 1.0001 ELSE 1.02 END
      AS v FROM lineitem), g AS (SELECT l_suppkey AS id, l_extendedprice AS v FROM lineitem),
    pr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v) AS r FROM p),
    gr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v) AS r FROM g)
    SELECT id, count(*) AS n_pred, count(*) AS n_gold,
    count(*) FILTER (WHERE abs(pr.v - gr.v) / greatest(pr.v, gr.v) > 0.01) = 0 AS matches
    FROM pr JOIN gr USING (id, r) GROUP BY 1""",
)
def _(spark, sf):
    # Results of one float column, thousands of rows per group and no exact cell to pair by.
    gold = t.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_extendedprice").alias("v"))
    factor = F.when(F.col("id") % 2 == 0, 1.0001).otherwise(1.02)
    pred = gold.select("id", (F.col("v") * factor).alias("v"))
    return compare.result_diff(pred, gold, by=["id"]).drop("unmatched")


@query(
    "result_diff_two_floats",
    _RESULTS.replace("max(l_extendedprice) AS top", "max(l_extendedprice) AS top, sum(l_tax) + 1 AS tax").replace(
        "END AS top", "END AS top, sum(l_tax) + 1 AS tax").replace(
        "greatest(p.top, g.top) > 0.01)", "greatest(p.top, g.top) > 0.01 OR abs(p.tax - g.tax) / greatest(p.tax, g.tax) > 0.01)")
    + "SELECT id, n_pred, n_gold, n_pred = n_gold AND bad = 0 AS matches FROM sizes JOIN met USING (id)",
)
def _(spark, sf):
    # The exact cells name a row here, so pairing by them is all there is to decide.
    taxes = t.table(spark, sf, "lineitem").withColumn("_dropped", (F.col("l_returnflag") == "R") & (
        F.col("l_linestatus") == "O") & (F.col("l_quantity") == 7))

    def rows(df, factor):
        return df.groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("flag"),
                          F.col("l_quantity").cast("int").alias("quantity")).agg(
            F.count("*").alias("n"), (F.max("l_extendedprice") * factor).alias("top"), (F.sum("l_tax") + 1).alias("tax"))

    pred = rows(taxes.filter(~F.col("_dropped")), F.when(F.col("flag") == "A", 1.005).otherwise(1.0))
    return compare.result_diff(pred, rows(taxes, F.lit(1.0)), by=["id"]).drop("unmatched")


@query(
    "result_diff_questions",
    """WITH gold AS (SELECT o_custkey AS id, o_orderstatus AS s, count(*) AS n, round(avg(o_totalprice), 4) AS v FROM orders GROUP BY 1, 2)
    SELECT CAST(id AS VARCHAR) AS id, count(*) AS n_pred, count(*) AS n_gold,
    CASE WHEN id % 5 = 0 THEN false WHEN id % 5 = 1 THEN count(*) < 2 ELSE true END AS matches FROM gold GROUP BY id""",
)
def _(spark, sf):
    """Customers as questions. Every fifth lacks a column, every fifth is ordered and comes reversed;
    the rest is off by a thousandth and unordered."""
    gold = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("s")).agg(
        F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("v"))
    kind = F.col("id") % 5
    place = F.row_number().over(Window.partitionBy("id").orderBy("s")) - 1
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"))) - 1

    def cells(df, side, row, values, width):
        listed = F.slice(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(k).alias("kind"), v.cast("string").alias("value"))
                                   for c, (k, v) in enumerate(values)]), 1, width)
        return df.withColumn("row", row).select(F.col("id").cast("string").alias("id"), F.lit(side).alias("side"), "row",
                                                F.explode(listed).alias("c")).select("id", "side", "row", "c.*")

    values = [("text", F.col("s")), ("int", F.col("n"))]
    told = cells(gold, "gold", place, [*values, ("float", F.col("v"))], F.lit(3))
    guess = cells(gold, "pred", F.when(kind == 1, last).otherwise(place), [*values, ("float", F.col("v") * 1.001)],
                  F.when(kind == 0, 2).otherwise(3))
    questions = gold.select(F.col("id").cast("string").alias("id"), F.when(kind == 1, "SELECT s ORDER BY s").otherwise("SELECT s").alias("gold_sql")).distinct()
    return compare.result_diff_questions(told.unionByName(guess), questions).drop("unmatched")


@query(
    "tools_match",
    "SELECT id, list_sort(list_distinct(tools_called)) = list_sort(list_distinct(expected_tools)) AS same "
    "FROM outcomes",
    "outcomes",
)
def _(spark, sf):
    same = metrics.tools_match(F.col("tools_called"), F.col("expected_tools"))
    return t.outcomes(spark, sf).select("id", same.alias("same"))


@query(
    "tools_superset",
    "SELECT id, list_has_all(tools_called, expected_tools) AS covered FROM outcomes", "outcomes",
)
def _(spark, sf):
    covered = metrics.tools_superset(F.col("tools_called"), F.col("expected_tools"))
    return t.outcomes(spark, sf).select("id", covered.alias("covered"))


@query(
    "recall_at_k",
    "SELECT query_id, CASE WHEN list_contains(list(other ORDER BY score DESC, chunk_id)[1:3], label) "
    "THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall FROM (SELECT a.vec_id AS query_id, a.label, b.label AS "
    "other, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), "
    "9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity("
    "a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS r FROM embeddings a, embeddings b "
    "WHERE a.vec_id <> b.vec_id) WHERE r <= 4 GROUP BY query_id, label",
)
def _(spark, sf):
    from lamina.operators.search import knn_exact

    vectors = t.table(spark, sf, "embeddings")
    found = knn_exact(
        vectors, vectors, 5, query_id="vec_id", query_vector="embedding", chunk_id="vec_id"
    )
    labels = vectors.select("vec_id", "label")
    others = found.filter("query_id <> chunk_id").join(
        labels.withColumnRenamed("label", "other"), F.col("chunk_id") == F.col("vec_id")
    ).drop("vec_id")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "other")))
    listed = others.groupBy("query_id").agg(F.transform(ordered, lambda x: x["other"]).alias("retrieved"))
    joined = listed.join(labels, F.col("query_id") == F.col("vec_id"))
    recall = metrics.recall_at_k(F.col("retrieved"), F.array("label"), 3)
    return joined.select("query_id", recall.alias("recall"))


@query(
    "outcome_scoring",
    "SELECT id, category, sql_generated, CASE WHEN sql_generated IS NOT NULL THEN quality_ok WHEN has_gold THEN "
    "false END AS sql_valid, CASE WHEN has_gold THEN sql_generated IS NOT NULL AND quality_ok AND matched END AS "
    "sql_correct, CASE WHEN lang <> 'es' THEN CAST(toxic = 0 AS DOUBLE) END AS retrieval_hit, "
    + _any_of("lower(answer)", REFUSAL_MARKERS) + " AS refused FROM (SELECT d.doc_id AS id, lang AS category, lang, "
    "toxic, CASE WHEN lang <> 'de' THEN 'SELECT ' || n_chars END AS sql_generated, quality = 1 AS quality_ok, "
    "lang <> 'fr' AS has_gold, n_chars % 2 = 0 AS matched, CASE WHEN toxic = 1 THEN 'Désolé. ' || text ELSE "
    "text END AS answer FROM labels l JOIN documents d ON l.doc_id = d.doc_id)",
)
def _(spark, sf):
    documents = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id")
    id_col, gold = F.col("doc_id").alias("id"), F.array(F.lit("gold"))
    questions = documents.select(
        id_col, F.col("lang").alias("category"), "lang", F.array(F.lit("sql_query")).alias("expected_tools"),
        F.when(F.col("lang") != "fr", "SELECT 1").alias("gold_sql"),
        F.when(F.col("lang") != "es", gold).otherwise(F.array().cast("array<string>")).alias("gold_sources"),
    )
    answer = F.when(F.col("toxic") == 1, F.concat(F.lit("Désolé. "), "text")).otherwise(F.col("text"))
    answers = documents.select(
        id_col, answer.alias("answer"), F.array(F.lit("sql_query")).alias("tools_called"),
        F.when(F.col("lang") != "de", F.concat(F.lit("SELECT "), "n_chars")).alias("sql_generated"),
        (F.col("quality") == 1).alias("sql_ok"),
        F.when(F.col("toxic") == 0, F.array(F.lit("x"), F.lit("gold"))).otherwise(F.array(F.lit("x"))).alias("sources"),
    )
    comparisons = documents.select(id_col, (F.col("n_chars") % 2 == 0).alias("matches"))
    scored = metrics.outcome_scoring(questions, answers, comparisons)
    return scored.select(
        "id", "category", "sql_generated", "sql_valid", "sql_correct", "retrieval_hit", "refused"
    )


def _mean(expression: str, condition: str = "true") -> str:
    return f"avg(CASE WHEN {condition} THEN CAST({expression} AS DOUBLE) END)"


_ANSWERABLE, _NOT = "category <> 'unanswerable'", "category = 'unanswerable'"
_METRICS = {
    "sql_execution_accuracy": _mean("sql_correct"),
    "sql_valid_rate": _mean("sql_valid"),
    "routing_accuracy": _mean("tools_called = expected_tools", _ANSWERABLE),
    "routing_superset_rate": _mean("list_has_all(tools_called, expected_tools)", _ANSWERABLE),
    "retrieval_recall": "avg(retrieval_hit)",
    "faithfulness_mean": "avg(faithfulness)",
    "faithfulness_at_least_4": _mean("faithfulness >= 4"),
    "answer_correctness_mean": "avg(answer_correctness)",
    "refusal_accuracy": _mean("refused", _NOT),
    "false_refusal_rate": _mean("refused", _ANSWERABLE),
    "number_grounding": "CAST(sum(numbers_grounded) AS DOUBLE) / nullif(sum(numbers_checked), 0)",
    "latency_p50_ms": "quantile_cont(CAST(nullif(latency_ms, 0) AS DOUBLE), 0.5)",
    "latency_p95_ms": "quantile_cont(CAST(nullif(latency_ms, 0) AS DOUBLE), 0.95)",
}


def _summary(relation: str = "outcomes") -> str:
    shown = ", ".join(f"round({sql}, 6) AS {name}" for name, sql in _METRICS.items())
    return (
        f"SELECT config, CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS scope, count(*) AS n, "
        f"count(error) AS n_errors, {shown} FROM {relation} GROUP BY GROUPING SETS ((config), (config, category))"
    )


def _rounded(df):
    return df.select(*[F.round(n, 6).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


@query("metrics_aggregate", _summary(), "outcomes")
def _(spark, sf):
    return _rounded(metrics.metrics_aggregate(t.outcomes(spark, sf)))


@query(
    "rescore",
    "SELECT s.*, coalesce(w.wall_time_s, 0.0) AS wall_time_s FROM ("
    + _summary("(SELECT * REPLACE (" + _any_of("lower(answer)", REFUSAL_MARKERS) + " AS refused) FROM outcomes)")
    + ") s LEFT JOIN (SELECT DISTINCT source AS config, CAST(60.0 AS DOUBLE) AS wall_time_s FROM documents "
    "WHERE source <> 'src1') w USING (config)",
    "outcomes",
)
def _(spark, sf):
    # From the files of a run: what was stored as not refused is found again in the whole answers.
    path = _folder(spark, "rescore")
    sinks.sink_run_csv(t.outcomes(spark, sf).withColumns({"refused": F.lit(False), "question": F.lit("?")}), path, "20260101-000000")
    stored = files.scan_run_csv(spark, path)
    documents = t.table(spark, sf, "documents").select(F.col("source").alias("config")).distinct()
    walls = documents.filter("config <> 'src1'").withColumn("wall_time_s", F.lit(60.0))
    return _rounded(metrics.rescore(stored, walls))


@query(
    "stratified_sample",
    "SELECT category, id FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id) AS r "
    "FROM outcomes) WHERE r <= greatest(1, CAST(floor(20 / (SELECT count(DISTINCT category) FROM outcomes)) AS BIGINT))",
    "outcomes",
)
def _(spark, sf):
    return metrics.stratified_sample(t.outcomes(spark, sf), 20).select("category", "id")


_MODE = """CASE WHEN error IS NOT NULL THEN 'crash'
    WHEN sql_correct = false AND sql_valid = true THEN 'wrong-sql'
    WHEN sql_valid = false THEN 'invalid-sql' WHEN retrieval_hit = 0.0 THEN 'retrieval-miss'
    WHEN category <> 'unanswerable' AND refused THEN 'false-refusal'
    WHEN category = 'unanswerable' AND NOT refused THEN 'missed-refusal'
    WHEN faithfulness <= 3 THEN 'unfaithful'
    WHEN numbers_checked <> 0 AND numbers_grounded <> numbers_checked THEN 'ungrounded-number' END"""


@query("failure_mode", f"SELECT id, {_MODE} AS mode FROM outcomes", "outcomes")
def _(spark, sf):
    return t.outcomes(spark, sf).select("id", failures.failure_mode().alias("mode"))


@query(
    "window_first_per_mode",
    f"SELECT mode, id, config, category FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY id) AS r "
    f"FROM (SELECT *, {_MODE} AS mode FROM outcomes)) WHERE r = 1 AND mode IS NOT NULL ORDER BY id LIMIT 5",
    "outcomes",
)
def _(spark, sf):
    run = t.outcomes(spark, sf).select(
        "id", "config", "category", "error", "sql_correct", "sql_valid", "retrieval_hit", "refused",
        "faithfulness", "numbers_checked", "numbers_grounded",
    )
    return failures.first_per_mode(run, "id").select("mode", "id", "config", "category")


@query(
    "failure_counts",
    """SELECT mode, count(*) AS questions FROM (SELECT unnest(list_filter([
      CASE WHEN error IS NOT NULL THEN 'run error' END,
      CASE WHEN sql_valid = false THEN 'no valid SQL' WHEN sql_correct = false THEN 'wrong SQL result' END,
      CASE WHEN retrieval_hit = 0.0 THEN 'retrieval miss' END,
      CASE WHEN category <> 'unanswerable' AND refused THEN 'false refusal' END,
      CASE WHEN category = 'unanswerable' AND NOT refused THEN 'missed refusal' END],
      lambda x: x IS NOT NULL)) AS mode FROM outcomes) GROUP BY 1""",
    "outcomes",
)
def _(spark, sf):
    return failures.failure_counts(t.outcomes(spark, sf))


def _pivot() -> str:
    names = {"latency_p50_ms": "latency_p50_s", "latency_p95_ms": "latency_p95_s"}
    rows = " UNION ALL ".join(
        f"SELECT config, '{names.get(m, m)}' AS metric, {m}{' / 1000' if m in names else ''} AS value FROM s"
        for m in _METRICS
    )
    long = f"WITH s AS (SELECT * FROM ({_summary()}) WHERE scope = 'overall') {rows}"
    return f"SELECT metric, config, round(value, 6) AS value FROM ({long})"


@query("metric_pivot", _pivot(), "outcomes")
def _(spark, sf):
    # A column for every configuration found, shown as rows: a view has columns known beforehand.
    summary = _rounded(metrics.metrics_aggregate(t.outcomes(spark, sf)))
    pivoted = metrics.metric_pivot(summary)
    return _rounded(pivoted.unpivot("metric", [c for c in pivoted.columns if c != "metric"], "config", "value"))


_BEST = (
    "SELECT config FROM (SELECT * FROM (" + _summary() + ") WHERE scope = 'overall') ORDER BY "
    "coalesce(sql_execution_accuracy, 0) DESC, coalesce(retrieval_recall, 0) DESC, "
    "coalesce(number_grounding, 0) DESC, config DESC LIMIT 1"
)


@query("best_config", _BEST, "outcomes")
def _(spark, sf):
    return metrics.best_config(_rounded(metrics.metrics_aggregate(t.outcomes(spark, sf))))


@query(
    "category_breakdown",
    "SELECT config, scope AS category, n, sql_execution_accuracy, retrieval_recall, faithfulness_mean, "
    f"number_grounding, round(latency_p50_ms / 1000, 6) AS latency_p50_s FROM ({_summary()}) WHERE scope <> "
    f"'overall' AND config = ({_BEST})",
    "outcomes",
)
def _(spark, sf):
    summary = _rounded(metrics.metrics_aggregate(t.outcomes(spark, sf)))
    return _rounded(metrics.category_breakdown(summary))
