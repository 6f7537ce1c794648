from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lamina.functions import calendar, indicators, numbers, text
from tests.conftest import rows


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def apply(spark, values, function, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(function(F.col("v"))).collect()]


def test_day_first_parsing(spark):
    raw = ["13/03/2018 07:45", "01/03/2018 00:15", "2018/03/01 00:15", "01/13/2018 00:15", None]
    assert apply(spark, raw, calendar.try_parse_day_first) == [
        datetime(2018, 3, 13, 7, 45), datetime(2018, 3, 1, 0, 15), None, None, None,
    ]


def test_strict_parsing_fails_the_job(spark):
    with pytest.raises(Exception, match="day-first"):
        apply(spark, ["2018/03/01 00:15"], calendar.parse_day_first)
    assert apply(spark, [None], calendar.parse_day_first) == [None]


def test_shift_boundaries(spark):
    stamps = [datetime(2018, 5, 4, *t) for t in ((5, 59), (6, 0), (13, 59), (14, 0), (21, 59), (22, 0), (0, 0))]
    assert apply(spark, stamps, calendar.shift_of, "timestamp_ntz") == list("NMMAANN")
    assert apply(spark, stamps, calendar.shift_date, "timestamp_ntz") == [
        date(2018, 5, 3), *[date(2018, 5, 4)] * 5, date(2018, 5, 3),
    ]


def test_interval_start_and_month_bounds(spark):
    assert apply(spark, [datetime(2018, 1, 1)], calendar.interval_start, "timestamp_ntz") == [
        datetime(2017, 12, 31, 23, 45)
    ]
    assert calendar.month_bounds(2018, 12) == (datetime(2018, 12, 1), datetime(2019, 1, 1))
    assert calendar.month_bounds(2018, 3) == (datetime(2018, 3, 1), datetime(2018, 4, 1))


def test_normalise_number(spark):
    cases = {
        "88": 88.0, "88.25": 88.25, "7 001,75": 7001.75, "7\u00a0001,75": 7001.75,
        "7\u202f001,75": 7001.75, "7\u2009001,75": 7001.75, "31 415 926,5": 31415926.5, "6,4": 6.4,
        "-0,5": -0.5, "+19": 19.0, "0,00031": 0.00031, "2,718.28": 2718.28, "2.718,28": 2718.28,
        "4,250": 4250.0, "4,25": 4.25, "": None, "n/a": None, "NaN": None, "3,1,4": None,
        "9,876,543": None,
    }
    assert apply(spark, list(cases), numbers.normalise_number) == list(cases.values())


def test_written_numbers(spark):
    found = apply(
        spark,
        ["Le four a pris 7 001,75 kg, soit 6,4 % de trop.", "seuil de 2 250,5 kWh", "aucun"],
        numbers.written_numbers,
    )
    assert found == [["7 001,75", "6,4"], ["2 250,5"], []]


def test_fr_number(spark):
    values = [959636.7, 12.0, -1234567.891]
    assert apply(spark, values, lambda c: numbers.fr_number(c, 1), "double") == [
        "959 636,7", "12,0", "-1 234 567,9",
    ]
    assert apply(spark, [1234.0], lambda c: numbers.fr_number(c, 0), "double") == ["1 234"]


def test_refusals(spark):
    refused = [
        "Je ne peux pas vous le dire.",
        "La météo est hors du périmètre de ces données.",
        "I cannot answer from these tables.",
        "I'm sorry, but I can't assist with salaries.",
        "Désolé, rien sur ce fournisseur.",
    ]
    answered = [
        "Cinquante-sept arrêts, selon la table des événements.",
        "The press drew 48210.5 kWh in May.",
    ]
    assert apply(spark, refused + answered, text.is_refusal) == [True] * 5 + [False] * 2


def test_language(spark):
    questions = ["Combien de tôles ?", "Quel est le total", "How many plates?", "la ligne sur la carte"]
    assert apply(spark, questions, text.detect_language) == ["fr", "fr", "en", "fr"]


def test_normalise_text(spark):
    raw = ["  Défaut Z_Scratch : actions, immédiates ! ", "ÀÉÎÕÜ Łódź ñ", "été", "日本 x"]
    assert apply(spark, raw, text.normalise_text) == [
        "defaut z scratch   actions  immediates", "aeiou  odz n", "ete", "x",
    ]


def test_hash_and_citation(spark):
    assert apply(spark, ["abc"], text.content_hash) == ["ba7816bf8f01cfea"]
    data = spark.createDataFrame(
        [
            (0, "doc", "POL-1", "Titre > Actions > Sous", None, None),
            (1, "doc", "POL-1", None, None, None),
            (2, "code", "a.py", "f", 12, 38),
            (3, "code", "a.py", None, None, None),
        ],
        "i int, t string, id string, s string, a int, b int",
    ).orderBy("i")
    shown = text.citation(F.col("t"), F.col("id"), F.col("s"), F.col("a"), F.col("b"))
    assert [r[0] for r in data.select(shown).collect()] == [
        "[POL-1 §Actions > Sous]", "[POL-1]", "a.py:L12-L38", "a.py",
    ]


def test_embed_text(spark):
    data = spark.createDataFrame(
        [(0, "doc", "D", "A > B", "body", "Titre"), (1, "doc", "D", None, "body", None),
         (2, "code", "m.py", "f", "x = 1", None), (3, "code", "m.py", None, "x", None)],
        "i int, t string, id string, s string, c string, title string",
    ).orderBy("i")
    shown = text.embed_text(F.col("t"), F.col("id"), F.col("s"), F.col("c"), F.col("title"))
    assert [r[0] for r in data.select(shown).collect()] == [
        "Titre > A > B\n\nbody", "D\n\nbody", "File: m.py\nSymbol: f\n\nx = 1",
        "File: m.py\nSymbol: module\n\nx",
    ]


def test_ratios_without_denominator(spark):
    one = spark.range(1)
    kwh, zero = F.lit(10.0), F.lit(0)
    assert one.select(
        indicators.energy_intensity(kwh, zero), indicators.co2_per_kwh(F.lit(1.0), zero),
        indicators.availability(zero, zero), indicators.performance(zero, zero),
        indicators.quality(zero, zero),
    ).first() == (None, None, 0.0, 0.0, 0.0)


def test_oee_does_not_floor_the_run_minutes_of_performance(spark):
    one = spark.range(1)
    over = [F.lit(v) for v in (480, 600, 100, 5)]
    assert one.select(indicators.oee(*over)).first()[0] == 0.0
    usual = [F.lit(v) for v in (480, 60, 200, 20)]
    expected = (420 / 480) * (200 / 7 / 42) * 0.9
    assert one.select(indicators.oee(*usual)).first()[0] == pytest.approx(expected)
    assert one.select(indicators.performance(F.lit(10_000), F.lit(60))).first()[0] == 1.0


def test_holds(spark):
    data = spark.createDataFrame(
        [("Z_Scratch", 1), ("Bumps", 1), ("Bumps", 2), ("Bumps", 3), ("Bumps", 9)], "f string, s int"
    )
    found = data.select(
        indicators.hold_hours(F.col("f"), F.col("s")), indicators.should_hold(F.col("f"), F.col("s"))
    ).collect()
    assert [tuple(r) for r in found] == [(72, True), (4, False), (24, True), (72, True), (4, True)]


def test_geometry(spark):
    data = spark.createDataFrame(
        [(0, 40, 0, 10, 100, 500), (0, 10, 0, 40, 0, 0), (0, 10, 5, 5, 7, 70), (0, 10, 0, 10, 50, 1)],
        "a int, b int, c int, d int, area int, lum int",
    )
    columns = [F.col(c) for c in ("a", "b", "c", "d", "area", "lum")]
    measures = indicators.defect_geometry(*columns)
    found = data.select(*[measures[n] for n in ("aspect_ratio", "fill_ratio", "mean_luminosity", "elongated")])
    assert [tuple(r) for r in found.collect()] == [
        (4.0, 0.25, 5.0, True), (0.25, 0.0, None, True), (None, None, 10.0, False), (1.0, 0.5, 0.02, False),
    ]
    assert rows(data.select(measures["box_area"])) == [(0,), (100,), (400,), (400,)]
