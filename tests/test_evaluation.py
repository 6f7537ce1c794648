import itertools
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina import schemas
from lamina.operators import compare, failures, metrics
from tests.conftest import rows


def verdict(spark, pred, gold, schema, gold_schema=None, position=None):
    p = spark.createDataFrame(pred, schema)
    g = spark.createDataFrame(gold, gold_schema or schema)
    found = compare.result_diff(p, g, position=position).collect()
    return found[0]["matches"]


@pytest.mark.parametrize(
    ("pred", "gold", "schema", "gold_schema", "expected"),
    [
        ([("west", 8), ("east", 5)], [("east", 5), ("west", 8)], "k string, n int", None, True),
        ([(73,)], [(71,)], "n int", None, False),
        ([(48210.5000000031,)], [(48210.5,)], "v double", None, True),
        ([(48210.5,)], [(40000.0,)], "v double", None, False),
        ([(Decimal("3.3333333333333333"),)], [(10 / 3,)], "v decimal(30,16)", "v double", True),
        ([("press", 12, "note")], [("press", 12)], "a string, n int, b string", "a string, n int", True),
        ([(4,), (6,)], [(4,)], "n int", None, False),
        ([(4,), (4,)], [(4,), (6,)], "n int", None, False),
        ([(float("nan"),)], [(float("nan"),)], "v double", None, True),
        ([(None, 1.0)], [(None, 1.001)], "k string, v double", None, True),
        ([(" a ",)], [("a",)], "k string", None, True),
        ([(3,)], [("3",)], "k int", "k string", False),
        ([(3,)], [(3.0,)], "k int", "k double", True),
        ([(True,)], [(1,)], "k boolean", "k int", True),
        ([], [], "k int", None, None),
    ],
)
def test_result_comparison(spark, pred, gold, schema, gold_schema, expected):
    p, g = spark.createDataFrame(pred, schema), spark.createDataFrame(gold, gold_schema or schema)
    found = compare.result_diff(p, g).collect()
    assert found[0]["matches"] is (True if expected is None else expected)


def test_missing_column_is_refused(spark):
    with pytest.raises(ValueError, match="fewer columns"):
        verdict(spark, [("L1",)], [("L1", 1)], "a string", "a string, n int")


def test_order_counts_when_given(spark):
    schema = "pos int, v string"
    assert not verdict(spark, [(0, "b"), (1, "a")], [(0, "a"), (1, "b")], schema, position="pos")
    assert verdict(spark, [(0, "a"), (1, "b")], [(0, "a"), (1, "b")], schema, position="pos")


def can_pair(pred, gold):
    def close(a, b):
        return abs(a - b) / max(abs(a), abs(b), 1e-9) <= 0.01

    return any(all(close(a, b) for a, b in zip(pred, order)) for order in itertools.permutations(gold))


def test_tolerant_pairing_equals_trying_every_pairing(spark):
    rng = np.random.default_rng(9)
    pred, gold, expected = [], [], {}
    for case in range(150):
        base = rng.choice([10.0, 10.05, 10.12, 10.2, 20.0, -5.0], rng.integers(1, 5))
        moved = rng.permutation(base * (1 + rng.choice([0, 0.004, -0.008, 0.0099, 0.012], len(base))))
        pred += [(case, float(v)) for v in moved]
        gold += [(case, float(v)) for v in base]
        expected[case] = can_pair(list(moved), list(base))
    found = compare.result_diff(
        spark.createDataFrame(pred, "q int, v double"), spark.createDataFrame(gold, "q int, v double"), by=["q"]
    )
    assert {r["q"]: r["matches"] for r in found.collect()} == expected
    assert 0 < sum(expected.values()) < len(expected)


@pytest.mark.parametrize("pair_rows", [500, 0])
def test_two_float_columns_equal_trying_every_pairing(spark, pair_rows):
    def close(a, b):
        return all(abs(x - y) / max(abs(x), abs(y), 1e-9) <= 0.01 for x, y in zip(a, b))

    rng = np.random.default_rng(4)
    pred, gold, expected = [], [], {}
    for case in range(120):
        count = rng.integers(1, 5)
        base = rng.choice([10.0, 10.06, 10.15, 20.0], (count, 2))
        moved = rng.permutation(base * (1 + rng.choice([0, 0.004, -0.007, 0.013], (count, 2), p=[0.4, 0.3, 0.2, 0.1])))
        pred += [(case, float(a), float(b)) for a, b in moved]
        gold += [(case, float(a), float(b)) for a, b in base]
        expected[case] = any(all(close(a, b) for a, b in zip(moved, order)) for order in itertools.permutations(base))
    schema = "q int, a double, b double"
    found = compare.result_diff(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema), by=["q"], pair_rows=pair_rows)
    verdicts = {r["q"]: r["matches"] for r in found.collect()}
    if pair_rows:
        assert verdicts == expected and 0 < sum(expected.values()) < len(expected)
    else:
        # Ranked only: never wrong, but open where ranks do not fit.
        assert all(v is None or v == expected[q] for q, v in verdicts.items()) and None in verdicts.values()


def test_ranks_of_one_column_do_not_decide_for_two(spark):
    schema = "a double, b double"
    pred, gold = [(1.0001, 5.0), (1.0, 9.0)], [(1.0, 5.0), (1.0001, 9.0)]
    assert verdict(spark, pred, gold, schema) is True


def test_many_copies_are_counted_not_listed(spark):
    many, few = spark.range(50_000).selectExpr("'x' as k"), spark.range(49_990).selectExpr("'x' as k")
    row = compare.result_diff(many, few).first()
    assert (row["n_pred"], row["n_gold"], row["unmatched"], row["matches"]) == (50_000, 49_990, 10, False)


def test_questions_of_different_shapes_in_one_job(spark):
    cells = []

    def result(question, side, *rows_):
        for n, row in enumerate(rows_):
            for c, value in enumerate(row):
                kind = "float" if isinstance(value, float) else "int" if isinstance(value, int) else "text"
                cells.append((question, side, n, c, kind, None if value is None else str(value)))

    result("ordered wrong", "pred", ("b", 1), ("a", 2))
    result("ordered wrong", "gold", ("a", 2), ("b", 1))
    result("ordered right", "pred", ("a", 2.001), ("b", 1.0))
    result("ordered right", "gold", ("a", 2), ("b", 1))
    result("any order", "pred", ("b", 1), ("a", 2))
    result("any order", "gold", ("a", 2), ("b", 1))
    result("too few columns", "pred", ("a",))
    result("too few columns", "gold", ("a", 1))
    result("extra column", "pred", (3, "note"))
    result("extra column", "gold", (3,))
    result("two floats", "pred", (1.0001, 5.0), (1.0, 9.0))
    result("two floats", "gold", (1.0, 5.0), (1.0001, 9.0))
    result("surplus", "pred", (1,), (1,), (1,))
    result("surplus", "gold", (1,))
    result("number and text", "pred", (3,))
    result("number and text", "gold", ("3",))
    result("nulls", "pred", (None, 1.0))
    result("nulls", "gold", (None, 1.0))
    result("gold is empty", "pred", (1,))
    result("no prediction", "gold", (1,))
    wanted = {
        "ordered wrong": False, "ordered right": True, "any order": True, "too few columns": False, "extra column": True,
        "two floats": True, "surplus": False, "number and text": False, "nulls": True, "gold is empty": False,
        "no prediction": False, "both empty": True,
    }
    questions = [(q, "SELECT x ORDER BY x" if q.startswith("ordered") else "SELECT x") for q in wanted]
    found = compare.result_diff_questions(
        spark.createDataFrame(cells, "id string, side string, row int, col int, kind string, value string"),
        spark.createDataFrame(questions, "id string, gold_sql string"),
    )
    assert {r["id"]: r["matches"] for r in found.collect()} == wanted


def most_pairs(fits):
    """The largest pairing by a plain search over the matrix of what fits."""
    owner = {}

    def find(row, seen):
        for column in np.flatnonzero(fits[row]):
            if column not in seen:
                seen.add(column)
                if column not in owner or find(owner[column], seen):
                    owner[column] = row
                    return True
        return False

    return sum(find(row, set()) for row in range(len(fits)))


def agree(a, b, tolerance):
    if a is None or b is None:
        return a is b
    if a != a or b != b:
        return a != a and b != b
    return a == b or (abs(a) < float("inf") and abs(b) < float("inf") and abs(a - b) / max(abs(a), abs(b), 1e-9) <= tolerance)


@pytest.mark.parametrize("seed", range(40))
def test_largest_pairing(seed):
    rng = np.random.default_rng(seed)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -1.0]

    def rows(n):
        return [[odd[rng.integers(6)] if rng.random() < 0.1 else float(rng.uniform(1, 1.4)) for _ in range(2 + seed % 2)] for _ in range(n)]

    left, right = rows(rng.integers(0, 40)), rows(rng.integers(0, 40))
    fits = np.array([[all(agree(a, b, 0.1) for a, b in zip(p, g)) for g in right] for p in left], bool).reshape(len(left), len(right))
    assert compare.largest_pairing(left, right, 0.1) == most_pairs(fits)


def test_thousands_of_rows_within_one_tolerance_are_decided(spark):
    """5,000 rows with two floats, all but a few near all others, and no column by itself tells the sides apart."""
    rng = np.random.default_rng(9)
    gold = [(float(x), float(y)) for x, y in rng.uniform(100, 101.5, (5000, 2))]
    pred = [(x * (1 + float(rng.uniform(-1, 1)) * 0.002), y * (1 + float(rng.uniform(-1, 1)) * 0.002)) for x, y in gold]
    rng.shuffle(pred)
    assert compare.largest_pairing(pred, gold, 0.01) == 5000
    # Six rows in a corner of their own that only five rows reach; each column still pairs by itself.
    corner = [(99.0, 102.6)] * 6
    gold_six = gold[6:] + corner
    pred_five = pred[6:] + corner[:5] + [(99.0, 100.5)]
    schema = "x double, y double"
    for given, wanted in ((pred, gold), (pred_five, gold_six)):
        found = compare.result_diff(spark.createDataFrame([(float(a), float(b)) for a, b in given], schema), spark.createDataFrame(wanted, schema)).first()
        assert found["matches"] is (wanted is gold) and found["unmatched"] == (0 if wanted is gold else 1)


def test_shuffled_result_matches_itself(spark):
    data = spark.range(3000).select((F.col("id") % 7).alias("k"), F.sin("id").alias("v"))
    shuffled = data.orderBy(F.rand(3)).withColumn("v", F.col("v") * 1.0000001)
    assert compare.result_diff(shuffled, data).first()["matches"]


def test_explicit_order_is_detected(spark):
    sql = spark.createDataFrame(
        [("SELECT x FROM t ORDER BY x",), ("select x from t order  by x",), ("SELECT x FROM t",), (None,)], "s string"
    )
    assert [r[0] for r in sql.select(compare.has_explicit_order(F.col("s"))).collect()] == [True, True, False, False]


def outcome(i, category, **values):
    names = [f.split()[0] for f in schemas.OUTCOMES.replace("array<string>", "array").split(", ")]
    row = dict.fromkeys(names)
    row.update(config="c", id=i, category=category, lang="fr", tools_called=[], expected_tools=[], refused=False,
               numbers_checked=0, numbers_grounded=0, latency_ms=0, answer="")
    row.update(values)
    return tuple(row[n] for n in names)


def summary(spark, *given):
    found = metrics.metrics_aggregate(spark.createDataFrame(list(given), schemas.OUTCOMES))
    return {r["scope"]: r for r in found.collect()}


def test_refusals_and_routing_split_by_answerability(spark):
    found = summary(
        spark, outcome("a", "unanswerable", refused=True), outcome("b", "unanswerable"),
        outcome("c", "sql", refused=True, tools_called=["x", "y"], expected_tools=["y", "x"]),
        outcome("d", "sql", tools_called=["x", "y"], expected_tools=["x"]),
    )
    all_rows = found["overall"]
    assert (all_rows["n"], all_rows["refusal_accuracy"], all_rows["false_refusal_rate"]) == (4, 0.5, 0.5)
    assert (all_rows["routing_accuracy"], all_rows["routing_superset_rate"]) == (0.5, 1.0)
    assert found["unanswerable"]["routing_accuracy"] is None
    assert found["sql"]["refusal_accuracy"] is None


def test_pooled_grounding_judges_and_latency(spark):
    found = summary(
        spark, outcome("a", "docs", numbers_checked=10, numbers_grounded=5, faithfulness=5.0, latency_ms=100),
        outcome("b", "docs", numbers_checked=1, numbers_grounded=1, faithfulness=3.0, latency_ms=200),
        outcome("c", "docs", latency_ms=0),
    )["overall"]
    assert found["number_grounding"] == pytest.approx(6 / 11)
    assert (found["faithfulness_mean"], found["faithfulness_at_least_4"]) == (4.0, 0.5)
    assert (found["latency_p50_ms"], found["latency_p95_ms"]) == (150.0, pytest.approx(195.0))
    assert found["sql_execution_accuracy"] is None and found["retrieval_recall"] is None


def test_nothing_to_aggregate(spark):
    assert summary(spark) == {}


def test_sets_and_recall(spark):
    data = spark.createDataFrame(
        [(["b", "a"], ["a", "b"]), (["a", "a"], ["a"]), (["a"], ["a", "b"]), (["x", "g"], []), ([], ["a"])],
        "got array<string>, want array<string>",
    )
    got, want = F.col("got"), F.col("want")
    found = data.select(
        metrics.tools_match(got, want), metrics.tools_superset(got, want), metrics.recall_at_k(got, want),
        metrics.recall_at_k(got, want, 1),
    ).collect()
    assert [tuple(r) for r in found] == [
        (True, True, 1.0, 1.0), (True, True, 1.0, 1.0), (False, False, 1.0, 1.0), (False, True, None, None),
        (False, False, 0.0, 0.0),
    ]


def test_outcomes_of_questions_whose_tool_failed(spark):
    questions = spark.createDataFrame(
        [(i, "fr", "sql", "?", ["sql_query"], gold, None, []) for i, gold in
         (("ran", "SELECT"), ("failed", "SELECT"), ("never", "SELECT"), ("free", None), ("unasked", None))], schemas.QUESTIONS,
    )
    answers = spark.createDataFrame(
        [("ran", "42", [], "S", True, []), ("failed", "42", [], "S", False, []), ("never", "désolé", [], None, None, []),
         ("free", "42", [], "S", True, []), ("unasked", "42", [], None, None, [])],
        "id string, answer string, tools_called array<string>, sql_generated string, sql_ok boolean, sources array<string>",
    )
    matched = spark.createDataFrame([("ran", True)], "id string, matches boolean")
    scored = metrics.outcome_scoring(questions, answers, matched)
    assert rows(scored, "id", "sql_valid", "sql_correct", "refused") == [
        ("failed", False, False, False), ("free", True, None, False), ("never", False, False, True),
        ("ran", True, True, False), ("unasked", None, None, False),
    ]


def test_sampling_takes_from_every_category(spark):
    data = spark.createDataFrame([(c, f"{c}{i}") for c in "abc" for i in range(9)], "category string, id string")
    assert rows(metrics.stratified_sample(data, 7), "id") == [(f"{c}{i}",) for c in "abc" for i in range(2)]
    assert metrics.stratified_sample(data, 1).count() == 3


def test_failure_modes(spark):
    given = [
        outcome("0", "sql", error="boom", sql_valid=False), outcome("1", "sql", sql_valid=True, sql_correct=False),
        outcome("2", "sql", sql_valid=False, sql_correct=False), outcome("3", "docs", retrieval_hit=0.0),
        outcome("4", "docs", refused=True), outcome("5", "unanswerable"), outcome("6", "docs", faithfulness=3.0),
        outcome("7", "docs", numbers_checked=2, numbers_grounded=1), outcome("8", "docs"),
        outcome("9", "sql", error="again"),
    ]
    df = spark.createDataFrame(given, schemas.OUTCOMES)
    assert rows(df.select("id", failures.failure_mode())) == [
        (str(i), m) for i, m in enumerate([*failures.EXPLANATIONS, None, "crash"])
    ]
    first = failures.first_per_mode(df, "id")
    assert rows(first, "id", "mode") == [(str(i), m) for i, m in enumerate(list(failures.EXPLANATIONS)[:5])]
    assert rows(failures.failure_counts(df)) == [
        ("false refusal", 1), ("missed refusal", 1), ("no valid SQL", 2), ("retrieval miss", 1), ("run error", 2),
        ("wrong SQL result", 1),
    ]


def test_pivot_best_and_breakdown(spark):
    given = [
        outcome("a", "sql", config="c0", sql_correct=True, latency_ms=2000), outcome("b", "docs", config="c0", retrieval_hit=0.0),
        outcome("c", "sql", config="c1", sql_correct=True, latency_ms=1000), outcome("d", "docs", config="c1", retrieval_hit=1.0),
    ]
    table = metrics.metrics_aggregate(spark.createDataFrame(given, schemas.OUTCOMES))
    assert rows(metrics.best_config(table)) == [("c1",)]
    pivot = {r["metric"]: (r["c0"], r["c1"]) for r in metrics.metric_pivot(table, ["c0", "c1"]).collect()}
    assert pivot["retrieval_recall"] == (0.0, 1.0) and pivot["latency_p50_s"] == (2.0, 1.0)
    assert rows(metrics.category_breakdown(table), "category", "n", "latency_p50_s") == [("docs", 1, None), ("sql", 1, 1.0)]


def test_rescoring_derives_refusals_again(spark):
    df = spark.createDataFrame([outcome("a", "sql", answer="I'm sorry, no."), outcome("b", "sql", answer="402")], schemas.OUTCOMES)
    walls = spark.createDataFrame([("other", 5.0)], "config string, wall_time_s double")
    found = metrics.rescore(df, walls).filter("scope = 'overall'").first()
    assert (found["false_refusal_rate"], found["wall_time_s"]) == (0.5, 0.0)


@pytest.mark.parametrize("case, matches", [("alike", True), ("off", False), ("counts", False), ("crossed", False)])
def test_large_groups_of_several_floats_are_decided(spark, case, matches):
    # The first values are so near each other that ranks mix rows up; the second tell them apart.
    rng = np.random.default_rng(3)
    gold = [("a", 100.0 + float(rng.random()) * 1e-3, 1.5 ** (n % 40), 7.0) for n in range(640)] + [("b", 1.0, 2.0, 3.0), ("c", None, float("nan"), float("inf"))]
    pred = [(t, x if x is None else x * (1 + float(rng.uniform(-1, 1)) * 1e-6), y, z) for t, x, y, z in reversed(gold)]
    if case == "off":
        pred = [(t, x, y * 1.1, z) for t, x, y, z in pred]
    elif case == "counts":
        pred = [("b", *row[1:]) if n == 9 else row for n, row in enumerate(pred)]
    elif case == "crossed":
        # Each column alone fits, their combinations do not.
        gold = [("a", 100.0 if n % 2 else 200.0, 5.0 if n % 4 < 2 else 50.0, 7.0) for n in range(1200)]
        pred = [("a", x, y, z) for _, x, y, z in gold]
        pred[0], pred[-1] = ("a", 200.0, 50.0, 7.0), ("a", 100.0, 5.0, 7.0)
    schema = "t string, x double, y double, z double"
    assert compare.result_diff(spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema)).first()["matches"] is matches


def test_groups_of_bounded_size_are_ranked_where_they_lie(spark, monkeypatch):
    """Only a group too large for one task is laid out in ranges of the whole order."""
    schema = "q int, v double"
    gold = [(q, float(n) if n else None) for q in range(3) for n in range(50)]
    pred = [(q, v and v * (1.02 if q == 1 else 1.001)) for q, v in gold if q != 2 or v != 7.0]
    sides = spark.createDataFrame(pred, schema), spark.createDataFrame(gold, schema)

    def verdicts(**more):
        rows = compare.result_diff(*sides, by=["q"], **more).collect()
        return sorted((r["q"], r["n_pred"], r["n_gold"], r["unmatched"], r["matches"]) for r in rows)

    by_ranges = verdicts(pair_rows=10)
    monkeypatch.setattr(compare, "rank_within", None)
    assert verdicts() == by_ranges
    assert [r[:3] + r[4:] for r in by_ranges] == [(0, 50, 50, True), (1, 50, 50, False), (2, 49, 50, False)]
