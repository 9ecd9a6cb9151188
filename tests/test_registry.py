"""Registered queries against their SQL on the smallest tables, and the zone stream against its batch form."""

import os

import duckdb
import pytest

from riverine.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(rows):
    return sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = tables.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(want)


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_zone_stream_equals_batch(spark):
    batch, stream = (registry.QUERIES[n](spark, SF) for n in ("str4_zone_storage", "str4_zone_stream"))
    assert plain(map(tuple, batch.collect())) == plain(map(tuple, stream.select(*batch.columns).collect()))
