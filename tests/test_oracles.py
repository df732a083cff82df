"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pytest

from hexcast.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    found = duck.execute(ORACLES[name])
    columns = {c[0]: str(c[1]) for c in found.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == columns
    order = sorted(columns)
    place = {c[0]: k for k, c in enumerate(found.description)}
    theirs = sorted([tuple(norm(r[place[c]]) for c in order) for r in found.fetchall()], key=repr)
    ours = sorted([tuple(norm(r[c]) for c in order) for r in df.collect()], key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0
