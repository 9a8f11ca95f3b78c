"""Operators with SQL give DuckDB's rows on the small tables."""

import duckdb
import pytest

from weftline.llm import registry

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    there = c.execute(registry.SQL[name])
    columns = sorted(x[0] for x in there.description)
    assert sorted(df.columns) == columns
    at = [[x[0] for x in there.description].index(n) for n in columns]
    want = sorted(repr([r[i] for i in at]) for r in there.fetchall())
    assert sorted(repr(list(r)) for r in df.select(columns).collect()) == want
