"""Every query against its SQL, and the entry's contract."""

import datetime
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from waymark import catalog, catalog_database, catalog_fetched, catalog_index, catalog_io, catalog_streams  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(value):
    if isinstance(value, float | Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(same(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in catalog.ORACLES:
        assert got or name == "index_faults"
        return
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows_of(want.columns, want.fetchall())


def test_resolve_batch_asks_every_object(spark, sf_dir):
    records = {r["code"]: r["address"] for r in catalog.address_format(spark, sf_dir).collect()}
    got = {r["q_id"]: r for r in catalog.QUERIES["resolve_batch"](spark, sf_dir).collect()}
    assert set(got) == set(records)
    assert {q // 1_000_000 for q, r in got.items() if r["code"] is not None} == {105, 106, 108, 109, 113}
    # Flats of one building can share an address, so one of the twins answers.
    twin = [q for q, r in got.items() if q // 1_000_000 == 109 and r["code"] is not None]
    assert len(twin) >= 0.9 * sum(q // 1_000_000 == 109 for q in got) and all(got[q]["text"] == got[got[q]["code"]]["text"] for q in twin)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
