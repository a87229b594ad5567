"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import detection, files, manifests, scoring, streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for m in (manifests, detection, scoring, streams, files) for n in m.SQL)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert ours == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())


def test_entry(spark, sf):
    assert entry.entry(spark).count() == 20
