import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions.numbers import NUMBER_PATTERN
from lamina.operators import grounding, leakage
from tests.conftest import rows

# (answer, evidence, checked, grounded, ungrounded)
CASES = [
    ("Four presses drew 48 210,5 kWh in May.", ["kwh\n48210.5"], 1, 1, []),
    ("Output rose to 51 000 units.", ["units | 48210.5"], 1, 0, ["51 000"]),
    ("roughly 48 211 kWh", ["48210.5"], 1, 1, []),
    ("grade 9 was rejected", ["grade 4"], 1, 0, ["9"]),
    ("1. Stop the belt. 2. Call line 2. Logged in 2021, 57 stops.", ["stops: 57"], 1, 1, []),
    ("Stop the belt and call the shift lead.", ["no figures here"], 0, 0, []),
    ("57 stops took 3 940 minutes on 64 rolls.", ["57", "3940"], 3, 2, ["64"]),
    ("Held for 36 hours, 3 940 minutes lost.", ["hold 36", "lost\n3940"], 2, 2, []),
    ("There were 57.", [], 1, 0, ["57"]),
    ("-61 or 61", ["61"], 2, 1, ["-61"]),
    ("9" * 400 + " and -" + "8" * 320, ["7" * 333], 2, 1, ["-" + "8" * 320]),
]


def tables(spark, cases):
    answers = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, answer string")
    outputs = [(i, o) for i, c in enumerate(cases) for o in c[1]]
    return answers, spark.createDataFrame(outputs, "id int, evidence string")


def test_grounding_cases(spark):
    found = {r["id"]: r for r in grounding.grounding_check(*tables(spark, CASES)).collect()}
    for i, (_, _, checked, grounded, missed) in enumerate(CASES):
        r = found[i]
        assert (r["numbers_checked"], r["numbers_grounded"], r["ungrounded"]) == (checked, grounded, missed), i


def accepted(value):
    """The closed intervals of evidence that support ``value``."""
    near, far = sorted((value * 0.99, value / 0.99))
    yield near, far
    # Up to a billionth, the tolerance is a hundredth of a billionth.
    yield value - 1e-11, value + 1e-11
    whole = np.rint(value)
    # Halves round to the even side, so an even number takes both its edges and an odd one neither.
    edges = [whole - 0.5, whole + 0.5] if whole % 2 == 0 else np.nextafter([whole - 0.5, whole + 0.5], whole)
    yield max(edges[0], np.nextafter(value - 1, value)), min(edges[1], np.nextafter(value + 1, value))


def test_grounding_equals_pairwise_comparison(spark):
    rng = np.random.default_rng(5)
    cases = []
    for _ in range(300):
        scale = 10.0 ** rng.integers(-4, 7)
        base = rng.normal() * scale
        near = [base * (1 + d) for d in rng.choice([0, 0.0096, 0.0104, -0.0096, -0.0104, 0.3], 4)]
        halves = [float(rng.integers(-9, 9)) + 0.5, float(rng.integers(-9, 9))]
        asked = [f"{v:.6f}" for v in (base, near[0], *halves, 0.0)]
        known = [f"{v:.6f}" for v in (*near[1:], float(rng.integers(-9, 9)) + rng.choice([0.0, 0.5, 0.4]))]
        cases.append((" ; ".join(asked), known))
    found = grounding.ground_numbers(*tables(spark, cases), skip_trivial=False).collect()
    assert len(found) == 5 * len(cases)
    for r in found:
        known = [float(v) for v in cases[r["id"]][1]]
        assert r["grounded"] == any(low <= e <= high for e in known for low, high in accepted(r["value"])), (r, known)


def test_extraction_equals_the_pattern(spark):
    texts = ["a 1 234,5 b -7 c +8.25", "12 345 678 x1y2", "1 234 5", "", "0,000512;1.5e3", "v1.2.3"]
    data = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = rows(grounding.extract_numbers(data, "id", "t"), "id", "position", "written")
    expected = [(i, p, m) for i, t in enumerate(texts) for p, m in enumerate(re.findall(NUMBER_PATTERN, t))]
    assert found == sorted(expected, key=repr)


def test_ratio(spark):
    data = spark.createDataFrame([(0, 0), (3, 2)], "c int, g int")
    from pyspark.sql import functions as F

    found = data.select(grounding.grounding_ratio(F.col("c"), F.col("g"))).collect()
    assert [r[0] for r in found] == [1.0, pytest.approx(2 / 3)]


def test_leakage(spark):
    questions = spark.createDataFrame([(1, "Défauts, par NUANCE !"), (2, "autre")], "id int, text string")
    # Only a run of other characters becomes one space: a comma and a blank stay two.
    examples = spark.createDataFrame([("défauts par nuance",), ("defauts   par nuance",)], "text string")
    assert rows(leakage.leakage_exact(questions, examples), "id") == []
    examples = spark.createDataFrame([("defauts  par nuance",), ("DÉFAUTS, par nuance",)], "text string")
    assert rows(leakage.leakage_exact(questions, examples), "id") == [(1,)]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "query_id int, vector array<float>")
    e = spark.createDataFrame([(7, [1.0, 0.1]), (8, [0.0, 1.0])], "chunk_id int, embedding array<float>")
    assert rows(leakage.leakage_embedding(q, e), "question_id", "example_id") == [(1, 7)]


def test_a_number_is_filed_once_where_whole_numbers_decide_nothing(spark):
    sizes = spark.createDataFrame([(5000.0,), (-150.5,), (102.0,), (101.0,), (0.0,)], "value double").select(
        "value", F.size(grounding._keys(F.col("value"), 0.01, 0)).alias("n"))
    assert dict(rows(sizes)) == {5000.0: 1, -150.5: 1, 102.0: 1, 101.0: 2, 0.0: 1}


def test_grounding_around_the_last_whole_number_that_decides(spark):
    pairs = [(n, v, e) for n, (v, e) in enumerate((v / 4, (v + d) / 4) for v in range(384, 424) for d in range(-6, 7))]
    answers = spark.createDataFrame([(n, f"{v:.2f}") for n, v, _ in pairs], "id int, answer string")
    evidence = spark.createDataFrame([(n, f"{e:.2f}") for n, _, e in pairs], "id int, evidence string")
    found = {r["id"]: (r["value"], r["grounded"]) for r in grounding.ground_numbers(answers, evidence, skip_trivial=False).collect()}
    assert found == {n: (v, abs(v - e) / max(v, e) <= 0.01 or round(v) == round(e) and abs(v - e) < 1) for n, v, e in pairs}
