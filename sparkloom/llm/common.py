"""Shared pieces of the corpus operators: staging tables and walking Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import stage, unstage, workspace

__all__ = ["SLICE_BYTES", "partitions", "slices", "small_batches", "stage", "unstage", "utf8", "workspace"]

#: Bytes of text that one numpy step works on at a time; longer single texts are handled alone.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch; rows are counted by Spark otherwise, whatever their size.
BATCH_BYTES = 4 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``; Arrow batches of its session get at most ``BATCH_BYTES`` (or one row) unless it has a limit of its own."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, BATCH_BYTES)
    return docs


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``limit`` at most."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
