"""Every query against its SQL in the other engine, on the smallest tables."""

import math

import duckdb
import pytest

from ledgerline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return None
    return float(v) if type(v).__name__ == "Decimal" or isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cursor = con.execute(registry.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
