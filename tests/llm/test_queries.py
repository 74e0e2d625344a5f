import os

import duckdb
import pytest

from linkflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_on_tables(spark, data, name):
    df = queries.queries()[name](spark, data)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in os.listdir(data):
        con.sql(f"create view {t.split('.')[0]} as from '{data}/{t}'")
    want = sorted(con.sql(queries.oracle_sql()[name]).fetchall())
    assert sorted(tuple(r) for r in queries.queries()[name](spark, data).collect()) == want
