"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _rows(rows, names, order):
    def value(v):
        return ("nan" if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v

    at = [names.index(c) for c in order]
    return sorted((tuple(value(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    found = db.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert _rows(df.collect(), df.columns, order) == _rows(found.fetchall(), names, order)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
