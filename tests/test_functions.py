import pytest
from pyspark.sql import functions as F

from sparkloom.functions import codelang, links, pages


def value(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("code", "lang"),
    [
        ("#!/bin/bash\nls", "bash"), ("import x from 'y'", "ts"), ("SELECT a", "sql"), ("print print", "plain"), ("print print print", "py"), ("<p>a</p><b>", "html"),
        ("<?xml?><a></a>", "xml"), ("FROM x\nRUN y", "docker"), ("package main\nfunc", "go"), ("#include <x>", "c"), ("import java.util", "java"), ("éand éand éand", "py"), ("xand and", "plain"), (".PHONY: a b.PHONY: c d.PHONY", "plain"), ("x.PHONY: a\\nb.PHONY: c\\nd.PHONY: e", "make"), ("a{}b c{}d e{}f", "json"), ("", "plain"), (None, "plain"),
    ],
)
def test_code_language(spark, code, lang):
    assert value(spark, codelang.code_language("code"), code=code) == lang


@pytest.mark.parametrize(
    ("markdown", "base", "expected"),
    [
        ("[a](/b) ![c](/d.jpg)", "https://example.com", "[a](https://example.com/b) ![c](https://example.com/d.jpg)"),
        ("[a](https://www.example.org)", "https://example.com", "[a](https://www.example.org)"),
        ("[a](/p#h) [b](/p?q=s) [c](#x)", "https://example.com", "[a](https://example.com/p#h) [b](https://example.com/p?q=s) [c](#x)"),
        ('[a](/b "t")', "https://example.com", '[a](/b "t")'),
        ("[a](b) [c](../d) [e](./f/./g)", "https://example.com/x/y/z?q", "[a](https://example.com/x/y/b) [c](https://example.com/x/d) [e](https://example.com/x/y/f/g)"),
        ("[a](/été)", "https://EXAMPLE.com:443", "[a](https://example.com/%C3%A9t%C3%A9)"),
        ("[a](/b)", "not a url", "[a](/b)"),
        ("[a](mailto:x@example.com)", "https://example.com", "[a](mailto:x@example.com)"),
        ("[a](//h/b)", "http://example.com", "[a](http://h/b)"),
        ("plain", "https://example.com", "plain"),
        ("", "https://example.com", ""),
    ],
)
def test_replace_links(spark, markdown, base, expected):
    assert value(spark, links.replace_links("m", "b"), m=markdown, b=base) == expected


@pytest.mark.parametrize(
    ("url", "name"),
    [
        ("https://blog.example.com/a/b/c", "example-blog-b-c"), ("https://www.example.com/", "example"), ("http://example.com", "example"), ("https://example.com/A%20b/c.d?x#y", "example-a-b-c-d"),
        ("no url", "output"), ("https://a.b.c.example.org/x", "example-c-x"), ("https://localhost/", "output"),
    ],
)
def test_filenames(spark, url, name):
    assert value(spark, links.url_to_filename("u"), u=url) == name


@pytest.mark.parametrize(("path", "name"), [("a/b.html", "a/b.md"), ("a/b", "a/b.md"), (".x", ".x.md"), ("a/.x.y", "a/.x.md"), ("b.c.html", "b.c.md"), ("https://example.com/q", "example-q.md")])
def test_output_path(spark, path, name):
    assert value(spark, links.output_path("p"), p=path) == name


def test_cache_key(spark):
    assert value(spark, links.cache_key("u"), u="https://a.b/é?x") == "https___a_b___x.txt"


@pytest.mark.parametrize(("url", "yes"), [("https://a", True), ("mailto:x", True), ("a/b", False), ("", False), (None, False), ("http://", False)])
def test_is_url(spark, url, yes):
    assert value(spark, links.is_url("u"), u=url) is yes


def test_page_attributes(spark):
    html = "<html lang='de'><meta property='og:url' content='https://e/x'>"
    assert value(spark, pages.html_lang("h"), h=html) == "de"
    assert value(spark, pages.meta_url("h"), h=html) == "https://e/x"
    assert value(spark, pages.html_lang("h"), h="<p>") is None
    attrs = F.create_map(F.lit("class"), F.lit(" a  b "))
    row = spark.range(1).select(F.lit("div").alias("tag"), attrs.alias("attrs"))
    assert row.select(pages.match_string()).first()[0] == "div undefined a b"
