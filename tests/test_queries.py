import duckdb
import pytest

import __spark_entry__ as entry_module

DATA = "/root/testdata/sf0.001"
CORE = [n for m in entry_module.MODULES for n in m.SQL]


@pytest.fixture(scope="module")
def con():
    import glob
    import os

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    import decimal

    if isinstance(v, decimal.Decimal):
        return float(v)
    return 0.0 if isinstance(v, float) and v == 0 else v


@pytest.mark.parametrize("name", CORE)
def test_matches_sql(spark, con, name):
    df = entry_module.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    r = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(str([plain(x[names.index(c)]) for c in cols]) for x in r.fetchall())


def test_every_query_has_a_name_once():
    assert len({n for m in entry_module.MODULES for n in m.QUERIES}) == sum(len(m.QUERIES) for m in entry_module.MODULES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
