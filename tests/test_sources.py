import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamina import schemas
from lamina.constants import ENERGY_COLUMNS, FAULT_TYPES, PLATE_COLUMNS
from lamina.sources import files, sinks
from tests.conftest import rows


def write(path, lines, encoding="utf-8"):
    path.write_text("\n".join(lines) + "\n", encoding=encoding)
    return str(path)


def test_energy_csv_with_byte_order_mark(spark, tmp_path):
    header = ",".join(ENERGY_COLUMNS)
    data = ["03/01/2018 00:15,3.17,2.95,0,0.0,73.21,100,900,Weekday,Wednesday,Light_Load",
            "03/01/2018 00:00,4.0,4.46,0,0.0,66.77,100,0,Weekday,Wednesday,Light_Load"]
    path = write(tmp_path / "energy.csv", [header, *data], "utf-8-sig")
    read = files.scan_energy_csv(spark, path)
    assert read.schema.simpleString() == spark.createDataFrame([], schemas.ENERGY_READINGS).schema.simpleString()
    assert rows(read, "ts", "usage_kwh", "nsm") == [
        (datetime(2018, 1, 3, 0, 0), 4.0, 0), (datetime(2018, 1, 3, 0, 15), 3.17, 900),
    ]


def test_missing_column_is_reported(spark, tmp_path):
    path = write(tmp_path / "energy.csv", ["date,Usage_kWh", "x,1"])
    with pytest.raises(ValueError, match="NSM"):
        files.scan_energy_csv(spark, path)


def plates(tmp_path, flags):
    names = [f[0] for f in FAULT_TYPES]
    header = ",".join([*PLATE_COLUMNS, "TypeOfSteel_A300", "TypeOfSteel_A400", *names])
    measures = ",".join(["1"] * len(PLATE_COLUMNS))
    return write(tmp_path / "plates.csv", [header, *[f"{measures},{f}" for f in flags]])


def test_one_hot_columns_collapse(spark, tmp_path):
    path = plates(tmp_path, ["1,0,0,1,0,0,0,0,0", "0,1,0,0,0,0,0,0,1"])
    found = files.scan_plates_csv(spark, path)
    assert rows(found, "fault_code", "steel_grade") == [("Other_Faults", "A400"), ("Z_Scratch", "A300")]


@pytest.mark.parametrize("flags", ["1,0,0,1,1,0,0,0,0", "1,0,0,0,0,0,0,0,0", "1,0,,1,0,0,0,0,0"])
def test_one_hot_needs_exactly_one(spark, tmp_path, flags):
    with pytest.raises(Exception, match="fault_code"):
        files.scan_plates_csv(spark, plates(tmp_path, [flags])).collect()


def test_markdown_front_matter(spark, tmp_path):
    lines = ["---", "doc_id: TEST-DOC", 'title: "Titre: de test"', "---", "# Titre", "", "Corps."]
    write(tmp_path / "a.md", lines)
    write(tmp_path / "B.md", ["# Sans", "texte"])
    write(tmp_path / "c.txt", ["not read"])
    found = {r["doc_id"]: r for r in files.scan_markdown(spark, str(tmp_path)).collect()}
    assert set(found) == {"TEST-DOC", "B"}
    assert found["TEST-DOC"]["metadata"] == {"doc_id": "TEST-DOC", "title": "Titre: de test"}
    assert found["TEST-DOC"]["body"] == "# Titre\n\nCorps."
    assert found["B"]["metadata"] == {}


def test_source_files_by_suffix(spark, tmp_path):
    for name in ("a.py", "b.sql", "c.md"):
        write(tmp_path / name, [name])
    assert rows(files.scan_code(spark, str(tmp_path))) == [("a.py", "a.py\n"), ("b.sql", "b.sql\n")]


def test_jsonl_skips_blank_lines(spark, tmp_path):
    line = json.dumps({"id": "Q1", "lang": "fr", "expected_tools": ["a", "b"], "gold_sql": None})
    path = write(tmp_path / "q.jsonl", [line, "", line.replace("Q1", "Q2")])
    read = files.scan_jsonl(spark, path)
    assert rows(read, "id", "expected_tools", "gold_sql") == [("Q1", ["a", "b"], None), ("Q2", ["a", "b"], None)]


def test_jdbc_reads_in_key_ranges():
    class Reader:
        def format(self, name):
            self.name = name
            return self

        def options(self, **options):
            self.given = options
            return self

        def load(self):
            return self

    class Session:
        read = Reader()

    reader = files.scan_jdbc(
        Session(), "jdbc:x", "plant.t", column="id", lower=0, upper=100, partitions=8, driver="d"
    )
    assert reader.name == "jdbc"
    assert reader.given == {
        "url": "jdbc:x", "dbtable": "plant.t", "partitionColumn": "id", "lowerBound": "0",
        "upperBound": "100", "numPartitions": "8", "driver": "d",
    }


def outcomes(spark, answer, config="c3"):
    row = (config, "Q1", "sql", "fr", ["a", "b"], ["a"], "SELECT 1", True, None, 1.0, None, 4.0, False,
           3, 2, 1200, answer, None)
    return spark.createDataFrame([row], schemas.OUTCOMES).withColumn("question", F.lit("Q, \"x\"?"))


def test_latest_run_wins_per_configuration(spark, tmp_path):
    path = str(tmp_path / "runs")
    sinks.sink_run_csv(outcomes(spark, "old"), path, "20260101-000000")
    sinks.sink_run_csv(outcomes(spark, ' say "hi",\nthere ' + "x" * 900), path, "20260103-000000")
    sinks.sink_run_csv(outcomes(spark, "other", "c/0"), path, "20260102-000000")
    read = {r["config"]: r for r in files.scan_run_csv(spark, path).collect()}
    assert set(read) == {"c3", "c/0"}
    row = read["c3"]
    assert row["answer"].startswith(' say "hi", there x') and len(row["answer"]) == 917
    assert (row["tools_called"], row["sql_valid"], row["sql_correct"], row["refused"]) == (["a", "b"], True, None, False)
    assert (row["retrieval_hit"], row["faithfulness"], row["latency_ms"], row["error"]) == (1.0, None, 1200, None)


def test_run_files_named_by_configuration_and_stamp(spark, tmp_path):
    header = ",".join(sinks.RUN_COLUMNS)
    for stamp, valid in (("20260101-000000", "True"), ("20260102-000000", "False")):
        cells = ["Q1", "sql", "fr", "?", "a||b", "", "", valid, "", "", "", "", "True", "", "0", "7", "x", ""]
        write(tmp_path / f"c-1-{stamp}.csv", [header, ",".join(cells)])
    read = files.scan_run_csv(spark, str(tmp_path)).collect()
    assert [(r["config"], r["sql_valid"], r["tools_called"], r["expected_tools"], r["numbers_checked"]) for r in read] == [
        ("c-1", False, ["a", "b"], [], 0)
    ]


def test_upsert_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "source_id string, v int")
    expected = [("a", 1), ("b", 3), ("b", 4), ("c", 5)]
    once = sinks.upsert_by_source(old, new)
    assert rows(once) == expected and rows(sinks.upsert_by_source(once, new)) == expected
    path = str(tmp_path / "t")
    sinks.sink_buckets(old, path, buckets=4)
    for given in (4, None):
        sinks.sink_upsert_buckets(spark, path, new, buckets=given)
        assert rows(spark.read.parquet(path), "source_id", "v") == expected
    # Another number of buckets would leave replaced rows where they are.
    with pytest.raises(ValueError, match="buckets"):
        sinks.sink_upsert_buckets(spark, path, new, buckets=8)


def test_answers_are_cut_on_request_only(spark):
    answer = "a" * 2000
    assert rows(sinks.run_rows(outcomes(spark, answer)), "answer") == [(answer,)]
    assert rows(sinks.run_rows(outcomes(spark, answer), answer_chars=800), "answer") == [("a" * 800,)]


@pytest.mark.parametrize("body", [["x,y", "1,2", "3,4,5"], ["x,y", "1"]])
def test_rows_of_another_width_fail(spark, tmp_path, body):
    write(tmp_path / "a.csv", body)
    scan = files.scan_csv(spark, str(tmp_path), {"x": "x"}, {"x": "int"})
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|token"):
        scan.collect()


def test_files_with_columns_in_another_order_fail(spark, tmp_path):
    write(tmp_path / "a.csv", ["x,y", "1,2"])
    write(tmp_path / "b.csv", ["y,x", "1,2"])
    with pytest.raises(Exception, match="(?i)header"):
        files.scan_csv(spark, str(tmp_path), {"x": "x", "y": "y"}, {"x": "int", "y": "int"}).collect()


def test_front_matter_with_repeated_and_nested_keys(spark):
    text = "---\ndoc_id: first\ntags:\n  - a: b\n- c: d\n# note: x\ndoc_id: second\nurl: http://h/p\n---\nbody"
    parsed = files.with_front_matter(spark.createDataFrame([("p.md", text)], "path string, text string")).first()
    assert (parsed["doc_id"], parsed["body"]) == ("second", "body")
    assert parsed["metadata"] == {"tags": "", "doc_id": "second", "url": "http://h/p"}


def test_lists_in_front_matter(spark):
    text = (
        "---\ntitle: T\ntags:\n  - rayure\n  - \"tôle, fine\"\n  # a note\n  - 42\nlines: [L1, 'L2', true, 1.5]\nempty: []\nowner:\n  name: x\n"
        "- l'arrêt\nnext: v\n- stray\n---\nbody"
    )
    parsed = files.with_front_matter(spark.createDataFrame([("p.md", text), ("q.md", "no block")], "path string, text string"))
    found = {r["path"]: r["metadata"] for r in parsed.collect()}
    assert found["q.md"] == {} and found["p.md"] == {
        "title": "T", "tags": "['rayure', 'tôle, fine', 42]", "lines": "['L1', 'L2', True, 1.5]", "empty": "[]", "owner": "[\"l'arrêt\"]", "next": "v",
    }


def test_empty_gold_is_an_error(spark, tmp_path):
    results = spark.createDataFrame([("Q1", 0, (1,))], "id string, position bigint, row struct<n:int>")
    questions = spark.createDataFrame([("Q1",), ("Q2",)], "id string")
    assert rows(sinks.empty_gold(results, questions)) == [("Q2",)]
    with pytest.raises(Exception, match="Q2"):
        sinks.sink_gold(results, questions, str(tmp_path / "gold"))


def test_reference_tables(spark):
    dims = files.seed_dims(spark)
    assert {k: v.count() for k, v in dims.items()} == {"production_lines": 3, "shifts": 3, "fault_types": 7}


def test_front_matter_is_read_once_per_document(spark):
    """The block and its entries are named many times in what follows, but worked out once."""
    given = spark.createDataFrame([("a.md", "---\ndoc_id: x\nlang: fr\nlang: en\n---\nbody")], "path string, text string")
    parsed = files.with_front_matter(given)
    plan = parsed.select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(text") == 1
    assert parsed.first()["metadata"] == {"doc_id": "x", "lang": "en"}
