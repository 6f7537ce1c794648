import random
from datetime import datetime, timedelta

import pytest

from lamina.operators.intervals import uncovered
from lamina.plans import maintenance
from tests.conftest import rows


def covered(intervals):
    """The whole numbers that intervals cover, each once."""
    return {n for s, e in intervals if s is not None and e is not None for n in range(s, e)}


@pytest.mark.parametrize("seed", range(3))
def test_union_equals_listing_every_point(spark, seed):
    dice = random.Random(seed)
    data = []
    for n in range(400):
        start = dice.randint(0, 900)
        # Most rows lie in one group, one of them is very long, some are empty or the wrong way round.
        data.append((dice.choice(["hot"] * 6 + ["a", None]), n, start, start + dice.choice([0, 1, 3, 3, 9, -4])))
    data += [("hot", 900, 100, 160), ("hot", 901, 100, 160), ("a", 902, None, 5), ("a", 903, 5, None), ("b", 904, 7, 8)]
    df = spark.createDataFrame(data, "k string, id int, s int, e int").repartition(7)
    parts = uncovered(df, ["k"], "s", "e")
    assert parts.columns == df.columns
    for key in {d[0] for d in data}:
        mine = [(r["s"], r["e"]) for r in parts.collect() if r["k"] == key]
        points = [n for s, e in mine for n in range(s, e)]
        assert len(points) == len(set(points)) and set(points) == covered([(d[2], d[3]) for d in data if d[0] == key])
        for r in parts.collect():
            assert any(d[1] == r["id"] and d[2] <= r["s"] < r["e"] == d[3] for d in data)


def test_nothing_to_unite(spark):
    assert uncovered(spark.createDataFrame([], "k string, s int, e int"), ["k"], "s", "e").collect() == []


def test_stops_are_counted_once_and_by_month(spark):
    at = datetime.fromisoformat
    data = [
        ("L1", at("2018-01-31T22:00:00"), at("2018-02-01T02:00:00")), ("L1", at("2018-01-31T23:00:00"), at("2018-02-01T01:00:00")),
        ("L1", at("2018-02-01T01:30:00"), at("2018-02-01T03:00:00")), ("L2", at("2018-03-05T00:00:00"), at("2018-03-05T00:00:30")),
        ("L2", at("2018-03-31T23:00:00"), at("2018-04-01T00:00:00")), ("L3", at("2018-01-15T00:00:00"), at("2018-04-02T00:00:00")),
    ]
    events = spark.createDataFrame(data, "line_id string, started_at timestamp_ntz, ended_at timestamp_ntz")
    found = {(r["line_id"], r["period"].month): r["stop_minutes"] for r in maintenance.distinct_stops(events).collect()}
    assert found == {("L1", 1): 120.0, ("L1", 2): 180.0, ("L2", 3): 60.5, ("L3", 1): 17 * 1440, ("L3", 2): 28 * 1440, ("L3", 3): 31 * 1440, ("L3", 4): 1440}
    assert rows(events.where("line_id = 'none'").transform(maintenance.distinct_stops)) == []
    # One day over many stops that all begin together.
    many = [("L1", at("2018-05-01T00:00:00"), at("2018-05-01T00:00:00") + timedelta(minutes=n)) for n in range(1, 300)]
    found = maintenance.distinct_stops(spark.createDataFrame(many, events.schema)).collect()
    assert [r["stop_minutes"] for r in found] == [299.0]
