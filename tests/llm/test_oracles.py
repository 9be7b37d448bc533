"""The operators that SQL can express against their SQL, at the smallest scale."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operator_matches_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.execute(ORACLES[name])
    columns = sorted(d[0] for d in found.description)
    order = [[d[0] for d in found.description].index(x) for x in columns]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(tuple(r[k] for k in order) for r in found.fetchall())
