import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkflow.operators import frontier
from linkflow.plans import catalogue


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"create view {name.split('.')[0]} as from '{data}/{name}'")
    return con


def canon(rows):
    return sorted(repr(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, data, db, name):
    got = entry.queries()[name](spark, data).toArrow().to_pylist()
    rel = db.sql(entry.oracle_sql()[name])
    columns = rel.columns
    assert canon(got) == canon(dict(zip(columns, r)) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["round_loop", "stream_politeness", "p2_found"])
def test_query_without_sql_runs(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["queue", "identifier", "pos", "url"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p4_found"} <= set(entry.queries())


def test_rounds_leave_no_due_host_out(spark, data, tmp_path, monkeypatch):
    schema = spark.read.parquet(f"{data}/crawl_uris.parquet").schema
    own = {"fetch_id": F.col("id"), "url": F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".test/")), "status_code": F.lit(200)}
    spark.range(10_050).select([own.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in schema]).write.parquet(f"{tmp_path}/crawl_uris.parquet")
    ready = []

    def one_round(at, queues, state, fetch, links, now, settings, dns):
        ready.append(frontier.ready_set(at, state, now, settings).count())
        return at, queues, state, 0

    monkeypatch.setattr(catalogue.rounds, "crawl_round", one_round)
    catalogue.queries()["round_loop"](spark, str(tmp_path))
    assert ready == [10_050]
