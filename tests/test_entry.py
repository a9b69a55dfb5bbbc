"""The entry points, and the plans of the core queries."""

import duckdb
import pytest

import __spark_entry__ as entry
from pumpwise.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_plan(spark, name):
    """Columns agree with the SQL's; nothing runs Python per row."""
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in (
        "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    ).split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    assert sorted(c[0] for c in result.description) == sorted(df.columns)
    assert len(result.fetchall()) == df.count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
