"""Edit distances of all pages, whatever their alphabet."""

import __spark_entry__


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_page_has_a_row(spark, tmp_path):
    pairs = [("Größe", "Grosse"), ("日本語の題", "日本の題名"), ("plain", "plan"), ("été \U0001f600", "ete"), ("only a title", None), (None, "seul"), (None, None)]
    html = ["<html><head>" + (f"<title>{t}</title>" if t else "") + "</head><body>" + (f"<h1>{h}</h1>" if h else "") + "<p>text</p></body></html>" for t, h in pairs]
    rows = [(i, f"https://example.com/{i}", x) for i, x in enumerate(html)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = __spark_entry__.queries()["title_distances"](spark, str(tmp_path)).collect()
    assert {r.page_id: r.distance for r in found} == {i: distance(t, h) if t and h else None for i, (t, h) in enumerate(pairs)}
    assert len(found) == len(pairs)
