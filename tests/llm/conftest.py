"""Small tables for the operators of the optional package."""

import os

import pytest


@pytest.fixture(autouse=True, scope="session")
def shared_folder(spark, tmp_path_factory):
    """Checkpoints of these tests go to a folder of their own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("given tables are absent")
    return path


@pytest.fixture(scope="session")
def make(spark):
    """A table from rows and a schema, over several partitions."""

    def build(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)

    return build


DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, component long"
