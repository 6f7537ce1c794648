import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import aggregates, ordered, relational
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows of which one key holds most and many values repeat."""
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(2000) < 0.7, "hot", rng.choice(["a", "b", "c"], 2000))
    values = np.round(rng.exponential(50, 2000), 1)
    data = [(i, str(k), float(v)) for i, (k, v) in enumerate(zip(keys, values))]
    return data, spark.createDataFrame(data, "id int, k string, v double").repartition(8)


def test_global_rank_is_the_sort_position(skewed):
    data, df = skewed
    expected = {row[0]: i for i, row in enumerate(sorted(data, key=lambda r: (r[2], r[0])))}
    found = ordered.global_rank(df, ["v", "id"])
    assert {r["id"]: r["rank"] for r in found.collect()} == expected


def test_rank_within_groups(skewed):
    data, df = skewed
    expected = {}
    for key in {r[1] for r in data}:
        group = sorted((r for r in data if r[1] == key), key=lambda r: (r[2], r[0]))
        expected.update({r[0]: i for i, r in enumerate(group)})
    found = ordered.rank_within(df, ["k"], ["v", "id"])
    assert {r["id"]: r["rank"] for r in found.collect()} == expected


@pytest.mark.parametrize("keys", [(), ("k",)])
@pytest.mark.parametrize("block", [4, 97, 10_000])
def test_moving_average_across_blocks(skewed, keys, block):
    data, df = skewed
    expected = {}
    for key in {r[1] for r in data} if keys else {None}:
        series = [r for r in data if key in (None, r[1])]
        for i, row in enumerate(series):
            frame = [r[2] for r in series[max(0, i - 3) : i + 1]]
            expected[row[0]] = sum(frame) / len(frame)
    found = ordered.moving_average(df, ["id"], "v", 3, keys, block_rows=block)
    assert {r["id"]: pytest.approx(r["moving_avg"]) for r in found.collect()} == expected


@pytest.mark.parametrize("times", [1, 60])
def test_percentiles_are_exact_for_small_and_large_groups(skewed, times):
    data, df = skewed
    copies = F.explode(F.sequence(F.lit(1), F.lit(times)))
    found = aggregates.exact_percentiles(df.withColumn("copy", copies), ["k"], "v", [0.5, 0.95, 0.0, 1.0])
    for r in found.collect():
        values = np.repeat([v for _, k, v in data if k == r["k"]], times)
        assert r["percentile"] == pytest.approx(np.quantile(values, r["fraction"])), r


@pytest.mark.parametrize("shape", ["id", "sqrt(id)", "id % 3", "case when id < 30000 then 7 else id end"])
def test_percentiles_of_many_rows_without_keys(spark, shape):
    df = spark.range(40_000).selectExpr(f"cast({shape} as double) as v")
    values = [r["v"] for r in df.collect()]
    found = aggregates.exact_percentiles(df, [], "v", [0.0, 0.1, 0.5, 0.75, 0.999, 1.0]).collect()
    assert len(found) == 6
    for r in found:
        assert r["percentile"] == pytest.approx(np.quantile(values, r["fraction"])), r


def test_percentile_of_few_values(spark):
    one = spark.createDataFrame([("a", 10.0), ("b", None)], "k string, v double")
    assert rows(aggregates.exact_percentiles(one, ["k"], "v", [0.95])) == [("a", 0.95, 10.0)]
    five = spark.createDataFrame([(float(v),) for v in range(1, 6)], "v double")
    assert rows(aggregates.exact_percentiles(five, [], "v", [0.5])) == [(0.5, 3.0)]


def test_top_per_group_limits_below_the_shuffle(skewed):
    data, df = skewed
    found = relational.top_per_group(df, ["k"], [F.desc("v"), F.asc("id")], 3)
    for key in {r[1] for r in data}:
        best = sorted((r for r in data if r[1] == key), key=lambda r: (-r[2], r[0]))[:3]
        chosen = found.filter(F.col("k") == key).orderBy("rank").collect()
        assert [(r["id"], r["rank"]) for r in chosen] == [(r[0], i) for i, r in enumerate(best, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_first_by_picks_the_smallest(skewed):
    data, df = skewed
    found = relational.first_by(df, ["k"], ["v", "id"], ["id"])
    expected = {k: min((r for r in data if r[1] == k), key=lambda r: (r[2], r[0]))[0] for k in {r[1] for r in data}}
    assert {r["k"]: r["id"] for r in found.collect()} == expected


def test_anti_references_and_flags(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(2,), (3,)], "y int")
    assert rows(relational.anti_references(a, b, "x", "y")) == [("left", "1"), ("right", "3")]
    keys = spark.createDataFrame([(1,), (2,)], "x int")
    assert rows(relational.exists_flag(keys, a.filter("x = 2"), "x")) == [(1, False), (2, True)]


def test_preview_and_default_limit(spark):
    shown, summary = relational.result_preview(spark.range(120))
    assert shown.count() == 50 and rows(summary) == [(120, True)]
    # The order of a sorted result is kept, and its plan runs once.
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    watched = spark.range(900, numPartitions=5).mapInArrow(counted, "id long").repartition(4).orderBy(F.desc("id"))
    shown, summary = relational.result_preview(watched, 3)
    assert [r["id"] for r in shown.collect()] == [899, 898, 897] and rows(summary) == [(900, True)]
    assert passed.value in (900, 1800)  # sorting samples its input first
    shown, summary = relational.result_preview(spark.range(2), 3)
    assert shown.count() == 2 and rows(summary) == [(2, False)]
    assert rows(relational.result_preview(spark.range(0))[1]) == [(0, False)]
    assert relational.limit_default(spark.range(500)).count() == 200
    assert relational.limit_default(spark.range(500), bare_aggregate=True).count() == 500
