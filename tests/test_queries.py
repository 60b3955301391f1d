"""Every engine query against DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from blockquery import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    own = duck.execute(queries.oracle_sql()[name])
    assert ordered(df.columns, rows) == ordered([d[0] for d in own.description], own.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries()) and set(queries.oracle_sql()) <= set(entry.oracle_sql())
    assert 0 < entry.entry(spark).count() <= 20
