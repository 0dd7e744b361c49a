"""Queries of this subpackage against their SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from fieldloom.llm.queries import oracle_sql, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        db.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(map(repr, (r[c] for c in columns))) for r in df.collect()), key=str)
    result = db.execute(oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(repr(r[i]) for i in at) for r in result.fetchall()), key=str)
