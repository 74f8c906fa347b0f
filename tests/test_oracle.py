"""Every core query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from gridcells.plans import registry

SAMPLE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SAMPLE}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 4)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SAMPLE)
    cols = sorted(df.columns)
    got = ordered([tuple(plain(v) for v in r) for r in df.select(*cols).collect()])
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    res = duck.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = ordered([tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()])
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-6, abs=2e-4) if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (*a, *b)) else a == b
