"""Every query against its SQL on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

from serixa.plans import registry

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert len(got)
    if name not in ORACLES:
        return
    want = duck.execute(ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert [str(t) for t in got[columns].dtypes] == [str(t) for t in want[columns].dtypes]
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() == 10
    assert set(module.oracle_sql()) <= set(module.queries()) and set(registry.queries()) <= set(module.queries())
