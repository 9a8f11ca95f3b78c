"""Every registered query with SQL gives DuckDB's rows on the small tables."""

from pathlib import Path

import pytest

from weftline.plans import console, digest, retrieval, store  # noqa: F401  the others add their queries to those of console

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(console.SQL))
def test_same_rows(spark, duck, name):
    df = console.QUERIES[name](spark, DATA)
    there = duck.execute(console.SQL[name])
    columns = [x[0] for x in there.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(there.fetchall(), columns)
