"""The operators' SQL gives the queries' rows."""

import duckdb
import pytest

from serixa.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted(map(str, rows)) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
