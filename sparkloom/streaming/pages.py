"""Pages from a stream.

Column functions work on streams as they are. Conversion groups a page's nodes, so it runs on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.pages import html_lang
from ..operators.markdown import Options, html_to_markdown


def read_stream(spark, path: str, schema: str = "page_id bigint, url string, html string", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def convert_stream(pages: DataFrame, sink: Callable[[DataFrame, int], None], options: Options = Options(), extractors=None, id_col: str = "page_id") -> DataStreamWriter:
    """A writer that converts every micro-batch and hands (page_id, lang, markdown) to ``sink`` with the batch's number."""

    def convert(batch: DataFrame, number: int) -> None:
        sink(html_to_markdown(batch, options, extractors, id_col=id_col), number)

    return pages.writeStream.foreachBatch(convert)


def languages_over_time(pages: DataFrame, time_col: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, lang, pages): counts of pages by language over event time, with a watermark for late rows."""
    return pages.withWatermark(time_col, late).groupBy(F.window(time_col, window), html_lang("html").alias("lang")).agg(F.count("*").alias("pages"))
