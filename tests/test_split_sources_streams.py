import pytest
from pyspark.sql import functions as F

from sparkloom.operators import split
from sparkloom.operators.extract import page_nodes
from sparkloom.session import stage
from sparkloom.sources import pages as sources
from sparkloom.streaming import pages as streams

HTML = "<h1>A</h1><p>" + "a " * 30 + "</p><h2>a1</h2><p>x</p><h2>a2</h2><p>" + "y " * 40 + "</p><h1>B</h1><p>b</p><p>c</p><h1>C</h1><p>" + "z " * 30 + "</p><p>1</p><p>2</p><p>3</p>"


@pytest.fixture(scope="module")
def tops(spark):
    return stage(split.top_nodes(stage(page_nodes(spark.createDataFrame([(1, HTML), (2, "<p>only</p>"), (3, "<ul><li>" + "x" * 99 + "<li>y</ul>")], "page_id long, html string")))))


def chunks(tops, most):
    found = split.split_nodes(tops, most).orderBy("page_id", "chunk_no").collect()
    return {p: [r.markdown for r in found if r.page_id == p] for p in (1, 2, 3)}


def test_large_enough(tops):
    assert [len(x) for x in chunks(tops, 1000).values()] == [1, 1, 1]


def test_headings_first_then_halves(tops):
    got = chunks(tops, 80)
    y, z = ("y " * 40).strip(), ("z " * 30).strip()
    assert got[1][1:] == ["## a1\n\nx\n", "## a2\n", f"{y}\n", "# B\n\nb\n\nc\n", f"# C\n\n{z}\n\n1\n\n2\n\n3\n"]
    assert got[3] == ["- " + "x" * 99 + "\n- y\n"]  # one node is never cut


def test_order_is_kept_and_sizes_hold(tops):
    whole = chunks(tops, 10_000)[1][0]
    for most in (20, 40, 90, 200):
        parts = chunks(tops, most)[1]
        assert "\n\n".join(p.rstrip("\n") for p in parts) + "\n" == whole
        assert all(len(p) <= most or "\n\n" not in p for p in parts)


def test_slices(spark):
    rows = spark.createDataFrame([([1, 2, 3],), ([],)], "x array<int>").select(split.slices_of("x", 2)).collect()
    assert [r[0] for r in rows] == [[[1, 2], [3]], []]


def test_loaders(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é\n</p>")
    assert sources.read_pages(spark, str(tmp_path), "local").first().html == "<p>é\n</p>"
    urls = spark.createDataFrame([("u1",), ("u2",), ("bad",), (None,), ("u1",)], "url string")

    def transport(url):
        if url == "bad":
            raise OSError("down")
        return f"<p>{url}"

    got = {r.url: (r.html, r.error) for r in sources.read_pages(spark, urls, "fetch", transport=transport).collect()}
    assert got == {"u1": ("<p>u1", None), "u2": ("<p>u2", None), "bad": (None, "OSError: down")}
    with pytest.raises(ValueError, match="Unsupported loader"):
        sources.read_pages(spark, "x", "browser")


def test_cache(spark):
    fetched = spark.createDataFrame([("https://a/b", "1"), ("https://a_b", "2"), ("https://c", None)], "url string, html string")
    cache = sources.to_cache(fetched)
    assert {(r.key, r.html) for r in cache.collect()} == {("https___a_b.txt", "1")}
    assert [r.url for r in sources.missing_from_cache(fetched, cache).collect()] == ["https://c"]


def test_output_paths_are_distinct(spark):
    rows = spark.createDataFrame([("https://e.com/a",), ("https://e.com/a?x",), ("https://e.com/b",)], "url string")
    got = {r.url: r.path for r in sources.with_output_path(rows, "url").collect()}
    assert got == {"https://e.com/a": "e-a.md", "https://e.com/a?x": "e-a_1.md", "https://e.com/b": "e-b.md"}


def test_write(spark, tmp_path):
    sources.write_rows(spark.range(3), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "u", "<h1>x</h1><p>y</p>"), (2, "v", "<p>z</p>")], "page_id bigint, url string, html string").write.parquet(src)
    got = {}
    query = streams.convert_stream(streams.read_stream(spark, src), lambda df, _: got.update({r.page_id: r.markdown for r in df.collect()}), extractors=False).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert got == {1: "# x\n\ny\n", 2: "z\n"}


def test_stream_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("2026-01-01 00:01:00", '<p lang="en">'), ("2026-01-01 00:02:00", '<p lang="en">'), ("2026-01-01 01:30:00", "<p>")], "ts string, html string").select(F.to_timestamp("ts").alias("ts"), "html").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, html string").parquet(src)
    query = streams.languages_over_time(stream, "ts").writeStream.outputMode("complete").format("memory").queryName("langs").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.lang, r.pages) for r in spark.table("langs").collect()} == {("en", 2), (None, 1)}
