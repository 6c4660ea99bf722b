"""Figures of pages whose titles were cut off within a character reference, against SQL."""

import __spark_entry__
from sparkloom.functions.markup import parse

CUT = "&amp &amp; &quot &quot; &copy &am &middot; a&amp"
PAGES = [(i, f'<html lang="en"><head><title>x {CUT}</title></head><body><nav><a href="/">n</a></nav><article><h1>x {CUT}</h1><p>{"some text " * n}&copy; y</article></body></html>') for i, n in enumerate((2, 60, 80))]


def same_as_sql(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame(PAGES, "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    query = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in query.description]
    found = __spark_entry__.queries()[name](spark, str(tmp_path)).select(columns)
    assert sorted(map(tuple, found.collect())) == sorted(query.fetchall())


def test_page_decisions_counts_as_its_sql(spark, tmp_path):
    same_as_sql(spark, tmp_path, "page_decisions")


def test_page_minimal_counts_as_its_sql(spark, tmp_path):
    same_as_sql(spark, tmp_path, "page_minimal")


def test_references_without_a_semicolon():
    text = "&amp &ampx; &amp; &#65 &#65; &#x42; &copy1; &copy; &zzz;"
    assert parse(text)[0]["value"] == "& &x; & A A B ©1; © &zzz;"
    assert parse(text, bare_references=False)[0]["value"] == "&amp &ampx; & &#65 A B &copy1; © &zzz;"
    assert parse("<title>a&amp</title>", bare_references=False)[1]["value"] == "a&amp"
