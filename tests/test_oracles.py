"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others give rows."""

from collections import Counter

import duckdb
import pytest
from tests.paths import SMALL

from retort.plans import catalog
from retort.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    rows = Counter(tuple(r[c] for c in columns) for r in frame.collect())
    assert rows
    if name in catalog.ORACLES:
        found = duck.sql(catalog.ORACLES[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == Counter(tuple(r[i] for i in at) for r in found.fetchall())
