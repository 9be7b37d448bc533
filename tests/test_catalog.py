"""Every query of the library against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from tidemark.catalog import ORACLES, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    return "-" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    order = [got.columns.index(c) for c in sorted(columns)]
    other = [columns.index(c) for c in sorted(columns)]
    assert sorted(tuple(cell(r[k]) for k in order) for r in rows) == sorted(tuple(cell(r[k]) for k in other) for r in found.fetchall())


def test_flagship(spark):
    assert flagship(spark, SF).count() == 3
