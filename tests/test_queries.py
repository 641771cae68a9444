"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from plumbline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    sql = duck.sql(registry.ORACLES[name])
    order = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert sorted(df.columns) == sorted(sql.columns)
    assert shown(got) == shown(tuple(r[i] for i in order) for r in sql.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
