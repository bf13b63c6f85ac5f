"""The registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from tickloom.plans import queries, sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def plain(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", list(sql.SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    out = duck.execute(sql.SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(map(plain, r)) for r in out.fetchall()), key=key)
    assert sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=key) == want


def test_every_sql_has_its_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_volatility_of_prices_without_a_logarithm_equals_sql(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    prices = {"zero": (0.0, 1.0, math.e**2), "none": (0.0, -1.0, 4.0), "plain": (1.0, math.e, None)}
    rows = ", ".join(f"({k}, TIMESTAMP '2024-01-01 10:00:00', 1, '{s}', CAST({'NULL' if p is None else p} AS DOUBLE), '{{\"k\": 1}}')" for s, ps in prices.items() for k, p in enumerate(ps))
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    columns = ["symbol", "sample_count", "volatility", "log_price_stddev"]
    got = sorted(tuple(map(plain, r)) for r in queries.QUERIES["a3_volatility"](spark, str(tmp_path)).select(columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({sql.SQL['a3_volatility']})").fetchall())
    assert {r[0]: r[3] for r in got} == {"zero": round(math.sqrt(2), 5), "none": None, "plain": round(math.sqrt(0.5), 5)}
