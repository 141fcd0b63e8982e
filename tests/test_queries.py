"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from trailmark import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{float(value):.6g}" if isinstance(value, float) else str(value)


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = df.collect()
    if name not in catalogue.ORACLES:
        assert df.columns
        return
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, found) == rows(columns, cursor.fetchall())


def test_names_agree():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
