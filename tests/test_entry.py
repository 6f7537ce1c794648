"""The registered queries against their oracle SQL, on the smallest given tables."""

import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables are absent")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not set(entry.queries()) - set(entry.oracle_sql()) - set(entry.LLM_QUERIES)


@needs_data
def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize(
    "name",
    ["fault_counts_by_line", "window_moving_avg", "agg_percentile_exact", "hold_summary", "chunk_headings",
     "hybrid_search", "grounding_check", "result_diff_floats", "metrics_aggregate", "dq_required_fields"],
)
def test_query_equals_oracle(spark, name):
    import duckdb

    from check import canonical

    db = duckdb.connect()
    for table in TABLES.split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0 and canonical(got) == canonical(want)


@needs_data
def test_every_oracle_can_be_a_view():
    """A view keeps the text of a query: it can hold no statement and nothing of this process."""
    import duckdb

    db = duckdb.connect()
    for table in [*TABLES.split(), "pages"]:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    for name, sql in entry.oracle_sql().items():
        db.execute(f'CREATE VIEW "oracle_{name}" AS {sql}')
