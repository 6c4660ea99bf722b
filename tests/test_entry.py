"""The registered queries against their SQL over the smallest tables."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = __spark_entry__.queries()[name](spark, SF)
    query = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in query.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, query.fetchall())


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["page_id", "lang", "markdown"] and found.count() == 50
