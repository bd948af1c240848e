"""Every catalog query against its SQL, on the smallest test tables."""

import math
import os

import duckdb
import pytest

from siftlake.plans import catalog, monitoring, reports  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(plain(tuple(r))) for r in df.select(*columns).collect())
    if name not in catalog.ORACLE:
        assert got
        return
    sql = duck.sql(catalog.ORACLE[name])
    assert sorted(sql.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(repr(plain(r)) for r in duck.sql(f"SELECT {quoted} FROM ({catalog.ORACLE[name]})").fetchall())
