"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from cohortloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    return None if (x := float(v)) != x else round(x, 9) + 0.0  # DuckDB divides nothing by nothing to NaN, where a metric has no value


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted([tuple(map(plain, r)) for r in cursor.fetchall()], key=repr)
    assert sorted([tuple(map(plain, r)) for r in got.select(*names).collect()], key=repr) == want
