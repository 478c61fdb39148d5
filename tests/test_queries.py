"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from periodica.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    r = c.sql(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert sorted(repr([value(x[n]) for n in order]) for x in got) == sorted(repr([value(v) for _, v in sorted(zip(names, row))]) for row in r.fetchall())
