"""Every query against its SQL, run by DuckDB on the same tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from evscreen.plans.oracles import ORACLES
from evscreen.plans.queries import QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_all_but_the_simulation_have_sql():
    assert set(QUERIES) - set(ORACLES) == {"sampling_noise"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_sampling_noise(spark, sf_dir):
    """The published simulation's rates at a flip rate of one percent, within Monte-Carlo error."""
    rates = {r["rule"]: r["rate"] for r in QUERIES["sampling_noise"](spark, sf_dir).collect()}
    assert abs(rates["any_change"] - 0.632) < 0.04 and abs(rates["alpha"] - 0.446) < 0.05
    assert abs(rates["crossing_1"] - 0.048) < 0.025 and rates["crossing_2"] < 0.006
