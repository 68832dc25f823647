"""Every registered query against its SQL, as the driver compares them."""

import os

import duckdb
import pytest

from sparsetrack.plans import catalog

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = df.toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    cols = sorted(df.columns)
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    rows = [tuple(r[names.index(c)] for c in cols) for r in want.fetchall()]
    mine = [tuple(None if v != v else (v.item() if hasattr(v, "item") else v) for v in r) for r in got[cols].itertuples(index=False)]
    plain = lambda r: tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)
    assert sorted(map(plain, mine), key=key) == sorted(map(plain, rows), key=key)
