"""Every query with SQL against DuckDB on the supplied tables."""

import os

import duckdb
import pytest

from foldcast import registry

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for f in os.listdir(DIR):
        out.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return out


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, db, name):
    got = registry.queries()[name](spark, DIR)
    found = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted(str(r) for r in found.fetchall())
    assert want
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == want


def test_entry(spark):
    import __spark_entry__

    row = __spark_entry__.entry(spark).first()
    assert row.strategy == "weighted" and row.sharpe_ratio is not None
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
