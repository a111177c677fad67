"""Every query against its oracle on the smallest driver tables, as the driver compares them."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


PROPER = sorted(entry.catalog.QUERIES)


@pytest.mark.parametrize("name", PROPER)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    r = duck.execute(sql)
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 30


def test_pool_without_names(spark, tmp_path):
    """A supplier or nation without a name gives a line that is null, once for each customer; customers without a key or nation stay as in SQL."""
    c = duckdb.connect()
    c.execute("create table nation as select * from (values (1, 'A'), (2, null), (3, 'C')) v(n_nationkey, n_name)")
    c.execute("create table supplier as select * from (values (1::bigint, 's', 1), (2, null, 1), (3, null, 1), (4, 't', 2), (5, 's', 1), (6, 'u', null), (7, '', 3)) v(s_suppkey, s_name, s_nationkey)")
    c.execute("create table customer as select * from (values (1::bigint, 1), (2, 2), (3, null), (null, 1), (4, 3), (5, 1)) v(c_custkey, c_nationkey)")
    for t in ("nation", "supplier", "customer"):
        c.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    df = entry.queries()["evidence_pool"](spark, str(tmp_path))
    r = c.execute(entry.oracle_sql()["evidence_pool"])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in r.description], r.fetchall())
