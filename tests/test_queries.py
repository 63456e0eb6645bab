"""Every registered query against its DuckDB text on the smallest tables."""

import math

import duckdb
import pytest

from threadline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOUND = registry()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return "null" if math.isnan(v) else f"{v + 0.0:.6g}"
        return "null" if v is None else str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in FOUND.items() if sql])
def test_as_duckdb(spark, duck, name):
    plan, sql = FOUND[name]
    df = plan(spark, SF)
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, sql) in FOUND.items() if not sql])
def test_others_run(spark, name):
    df = FOUND[name][0](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0
