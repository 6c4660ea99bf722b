"""Replies, SQL functions, failures of single pages, and one file for each row."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.replies import mean_rating, read_reply
from sparkloom.functions.sql import register
from sparkloom.operators.extract import apply_extractors, page_errors, page_nodes, per_page
from sparkloom.operators.split import split_nodes
from sparkloom.sources.files import existing_paths, settled_paths, write_files


def test_replies(spark):
    cases = {
        '{"analysis": "a", "issues": ["x", "y"], "score": 70}': (70.0, ["x", "y"], "a", None),
        '{"score": 0}': (0.0, [], "", None),
        '{"score": 100.0, "issues": null, "more": 1}': (100.0, [], "", None),
        '{"score": 101}': (-1.0, [], "", "score out of range"),
        '{"score": -0.5, "issues": ["x"]}': (-1.0, [], "", "score out of range"),
        '{"issues": ["x"]}': (-1.0, [], "", "no score"),
        '{"score": 70': (-1.0, [], "", "not the JSON asked for"),
        '{"score": "high"}': (-1.0, [], "", "not the JSON asked for"),
        '{"score": 7, "issues": "x"}': (-1.0, [], "", "not the JSON asked for"),
        "I can't rate this.": (-1.0, [], "", "not the JSON asked for"),
        "": (-1.0, [], "", "not the JSON asked for"),
        None: (-1.0, [], "", "no reply"),
    }
    df = spark.createDataFrame([(t, i) for i, t in enumerate(cases)], "reply string, i int")
    got = {r.i: tuple(r.r) for r in df.select("i", read_reply("reply").alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    row = mean_rating(df.withColumn("g", F.lit(1)), "reply", "g").first()
    assert (row["items"], row["failed"], row["issues"]) == (12, 9, 2) and row["mean_score"] == round((170 - 9) / 12, 6)


def test_sql_functions(spark):
    register(spark)
    rows = [(p, k, ["h1", "paragraph", "list", "h2"][(p * k) % 4], "word " * (k % 9 + p)) for p in range(6) for k in range(1, 4 + 7 * p)]
    nodes = spark.createDataFrame(rows, "page_id long, place int, node string, markdown string").repartition(3)
    nodes.createOrReplaceTempView("top_nodes_view")
    got = spark.sql("SELECT * FROM split_chunks(120, TABLE(top_nodes_view) PARTITION BY page_id ORDER BY place)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, split_nodes(nodes, 120).collect())) and len(got) > 40
    spark.createDataFrame([("<p>a<b>b",), (None,)], "html string").createOrReplaceTempView("some_html")
    assert sorted(r[0] for r in spark.sql("SELECT size(parse_html(html)) FROM some_html").collect()) == [0, 4]


def test_a_page_that_fails_is_set_apart(spark):
    pages = spark.createDataFrame([(i, f"<div><p>page {i}</p><i>x</i></div>" + ("<hr>" if i == 37 else "")) for i in range(100)], "page_id long, html string").repartition(4)

    def keep(nodes):
        if any(n["tag"] == "hr" for n in nodes):
            raise RuntimeError("no rules, please")
        return [n["id"] for n in nodes if n["tag"] != "i" and n["value"] != "x"]

    nodes = page_nodes(pages)
    kept = apply_extractors(nodes, [per_page(keep)])
    assert [tuple(r) for r in page_errors(kept).collect()] == [(37, "RuntimeError: no rules, please")]
    sizes = {r.page_id: r["count"] for r in kept.where("kind != 'error'").groupBy("page_id").count().collect()}
    assert sizes.pop(37) == 6 and set(sizes.values()) == {3} and len(sizes) == 99
    again = apply_extractors(nodes, [per_page(keep), per_page(lambda nodes: [n["id"] for n in nodes])])
    assert page_errors(again).count() == 1
    with pytest.raises(Exception, match="no rules, please"):
        apply_extractors(nodes, [per_page(keep, on_error="raise")]).collect()


def test_one_file_a_row(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"https://a.example/{i % 3}", f"text {i} é") for i in range(9)] + [("notes.html", None)], "url string, markdown string").repartition(4)
    named = settled_paths(rows)
    write_files(named, folder)
    files = sorted(os.listdir(folder))
    assert files == ["_pending", *sorted(f"a-{k}{n}.md" for k in range(3) for n in ("", "_1", "_2")), "notes.md"]
    assert {open(f"{folder}/{f}").read() for f in files if f != "_pending"} == {f"text {i} é" for i in range(9)} | {"\n"}
    # the next ones go beside those that exist
    more = settled_paths(rows, existing_paths(spark, folder))
    write_files(more, folder)
    assert len([f for f in os.listdir(folder) if f != "_pending"]) == 20
    with pytest.raises(Exception, match="files exist"):
        write_files(named, folder)
    assert len([f for f in os.listdir(folder) if f != "_pending"]) == 20 and all(f.endswith(".aborted") for f in os.listdir(f"{folder}/_pending"))


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"{i}.md", f"t{i}") for i in range(20)], "path string, markdown string").repartition(4)
    broken = rows.withColumn("path", F.when(F.col("path") == "13.md", "../x").otherwise(F.col("path")))
    with pytest.raises(Exception, match="not a path inside"):
        write_files(broken, folder)
    for _ in range(50):  # tasks of the failed job may still run
        left = [f for _, _, names in os.walk(folder) for f in names if not f.endswith(".aborted")]
        if not left:
            break
        time.sleep(0.2)
    assert left == [] and not os.path.exists(tmp_path / "x")
    write_files(rows, folder)
    assert sorted(f for f in os.listdir(folder) if f != "_pending") == sorted(f"{i}.md" for i in range(20))


def test_free_numbers(spark):
    taken = spark.createDataFrame([("a-b.md",), ("a-b_2.md",), ("other_1.md",)], "path string")
    pages = spark.createDataFrame([(f"https://a.example/b?{i}",) for i in range(4)], "url string")
    assert sorted(r.path for r in settled_paths(pages, taken).collect()) == ["a-b_1.md", "a-b_3.md", "a-b_4.md", "a-b_5.md"]
