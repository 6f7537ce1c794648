import pytest
from pyspark.sql import functions as F

from lamina.sources import versions as v
from tests.conftest import rows

SCHEMA = "source_id string, part int, text string"


@pytest.fixture()
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    old = spark.createDataFrame([(f"s{n % 20}", n, "old") for n in range(200)] + [(None, 0, "none")], SCHEMA)
    v.create_versioned(old, path, buckets=8)
    return path


def texts(df, source):
    return sorted(r["text"] for r in df.where(F.col("source_id") == source).collect())


def test_an_upsert_replaces_its_sources_and_shares_the_rest(spark, table):
    new = spark.createDataFrame([("s3", 0, "new"), ("s99", 1, "new")], SCHEMA)
    assert v.upsert_versioned(spark, table, new) == 1
    now, before = v.read_versioned(spark, table), v.read_versioned(spark, table, 0)
    assert now.schema == before.schema
    assert texts(now, "s3") == ["new"] and texts(now, "s99") == ["new"] and now.count() == 201 - 10 + 2
    assert texts(before, "s3") == ["old"] * 10 and before.count() == 201
    first, second = (v._manifest(v._Files(spark, table), n)["parts"] for n in (0, 1))
    changed = [b for b in second if first.get(b) != second[b]]
    assert 1 <= len(changed) <= 2 and set(first) <= set(second)
    # The same upsert again changes nothing but the number.
    assert v.upsert_versioned(spark, table, new) == 2 and rows(v.read_versioned(spark, table)) == rows(now)
    assert v.upsert_versioned(spark, table, new.limit(0)) == 3 and v.read_versioned(spark, table).count() == now.count()


def test_a_job_that_fails_midway_leaves_the_old_version(spark, table):
    broken = spark.range(100, numPartitions=4).select(
        F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("source_id"), F.col("id").cast("int").alias("part"),
        F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise("new").alias("text"))
    with pytest.raises(Exception, match="lost"):
        v.upsert_versioned(spark, table, broken)
    assert v.versions(spark, table) == [0]
    assert {r["text"] for r in v.read_versioned(spark, table).collect()} == {"old", "none"}


def test_files_written_but_not_published_are_not_read(spark, table, monkeypatch):
    def lost(*_):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(v._Files, "publish", lost)
    with pytest.raises(RuntimeError, match="driver lost"):
        v.upsert_versioned(spark, table, spark.createDataFrame([("s1", 0, "new")], SCHEMA))
    monkeypatch.undo()
    assert texts(v.read_versioned(spark, table), "s1") == ["old"] * 10


def test_of_two_writers_one_is_refused(spark, table, monkeypatch):
    new = spark.createDataFrame([("s1", 0, "mine")], SCHEMA)
    write = v._write

    def overtaken(files, frame):
        monkeypatch.setattr(v, "_write", write)
        v.upsert_versioned(spark, table, spark.createDataFrame([("s1", 0, "theirs")], SCHEMA))
        return write(files, frame)

    monkeypatch.setattr(v, "_write", overtaken)
    with pytest.raises(v.VersionConflict):
        v.upsert_versioned(spark, table, new)
    assert texts(v.read_versioned(spark, table), "s1") == ["theirs"] and v.versions(spark, table) == [0, 1]
    assert v.upsert_versioned(spark, table, new) == 2 and texts(v.read_versioned(spark, table), "s1") == ["mine"]
    with pytest.raises(v.VersionConflict):
        v.create_versioned(new, table)


def test_old_versions_expire(spark, table):
    for n in range(3):
        v.upsert_versioned(spark, table, spark.createDataFrame([("s1", 0, f"new {n}")], SCHEMA))
    before = rows(v.read_versioned(spark, table))
    assert v.expire_versions(spark, table, keep=2) == [0, 1] and v.versions(spark, table) == [2, 3]
    assert rows(v.read_versioned(spark, table)) == before and texts(v.read_versioned(spark, table, 2), "s1") == ["new 1"]
    with pytest.raises(Exception):
        v.read_versioned(spark, table, 0)


def test_no_table_and_an_empty_one(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        v.read_versioned(spark, str(tmp_path / "none"))
    path = str(tmp_path / "empty")
    v.create_versioned(spark.createDataFrame([], SCHEMA), path)
    assert v.read_versioned(spark, path).collect() == []
    v.upsert_versioned(spark, path, spark.createDataFrame([("a", 1, "x")], SCHEMA))
    assert rows(v.read_versioned(spark, path)) == [("a", 1, "x")]
