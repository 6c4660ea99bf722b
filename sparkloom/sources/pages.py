"""Reading pages by loader, caching fetched HTML, and writing results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import cache_key, output_path

#: Fixed value: sent with requests where no other is given.
USER_AGENT = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/125.0.0.0 Safari/537.36"
Transport = Callable[[str], str]


def http_get(url: str) -> str:
    """The default transport: one GET with a browser's user agent."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": USER_AGENT})) as reply:
        return reply.read().decode("utf-8", "replace")


def local_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of each file under ``path``, read as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def table_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).load(path)


def fetch_pages(urls: DataFrame, transport: Transport = http_get, url_col: str = "url", partitions: int | None = None) -> DataFrame:
    """(url, html, error): each url fetched once where the rows are; a failure is a row with its message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, transport(url), None))
                except Exception as e:  # a page that can't be had must not end the job
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    rows = urls.select(F.col(url_col).alias("url")).where("url is not null").distinct()
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, "url string, html string, error string")


def read_pages(spark: SparkSession, source, loader: str, **options) -> DataFrame:
    """Pages by loader: ``local`` (path), ``table`` (path) or ``fetch`` (DataFrame of urls)."""
    loaders = {"local": lambda: local_pages(spark, source), "table": lambda: table_pages(spark, source, **options), "fetch": lambda: fetch_pages(source, **options)}
    if loader not in loaders:
        raise ValueError(f"Unsupported loader: {loader}")
    return loaders[loader]()


def missing_from_cache(urls: DataFrame, cache: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows of ``urls`` whose cache key isn't in ``cache`` (column key)."""
    return urls.join(cache.select(F.col("key").alias("_key")).distinct(), cache_key(url_col) == F.col("_key"), "left_anti")


def to_cache(fetched: DataFrame) -> DataFrame:
    """(key, html) of what was fetched; urls that share a key share the entry of the smallest."""
    return fetched.where("html is not null").groupBy(cache_key("url").alias("key")).agg(F.min_by("html", "url").alias("html"))


def with_output_path(pages: DataFrame, source_col: str = "url") -> DataFrame:
    """Adds ``path``, the file name that a page's Markdown goes by; names that several pages share get _1, _2, … in order of the source."""
    from pyspark.sql import Window

    named = pages.withColumn("path", output_path(source_col))
    k = F.row_number().over(Window.partitionBy("path").orderBy(source_col)) - 1
    return named.withColumn("_k", k).withColumn("path", F.when(F.col("_k") == 0, F.col("path")).otherwise(F.concat(F.regexp_replace("path", r"\.[^.]*$", ""), F.lit("_"), F.col("_k"), F.regexp_extract("path", r"\.[^.]*$", 0)))).drop("_k")


def write_rows(rows: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a table as parquet, json, orc or text."""
    rows.write.mode(mode).format(format).save(path)
