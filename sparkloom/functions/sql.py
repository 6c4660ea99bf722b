"""The library's functions for SQL: ``register(spark)`` makes them callable in queries of the session.

* ``parse_html(html)``: the nodes of a page, an array of structs
* ``split_chunks(most, TABLE(nodes) PARTITION BY page_id ORDER BY place)``: chunks of the rows of top_nodes
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .markup import parse_html_function

# The kinds of nodes to cut at, in order.
LEVELS = ["h1", "h2", "h3", "h4", "h5", "h6", "list", "table", "code"]


class SplitChunks:
    """One page's nodes in, its chunks out; holds one page at a time."""

    def __init__(self) -> None:
        self.page, self.most, self.nodes = None, 0, []

    def eval(self, most: int, row: Row) -> None:
        self.page, self.most = row["page_id"], most
        self.nodes.append((row["node"], row["markdown"]))

    def terminate(self) -> Iterator[tuple]:
        waiting, number = [(0, self.nodes)] if self.nodes else [], 0
        while waiting:
            level, part = waiting.pop()
            if len(part) == 1 or sum(len(m) + 2 for _, m in part) - 1 <= self.most:
                number += 1
                yield self.page, number, "\n\n".join(m for _, m in part) + "\n"
                continue
            if level < len(LEVELS):
                cuts = [0, *(k for k in range(1, len(part)) if part[k][0] == LEVELS[level]), len(part)]
            else:
                cuts = [0, -(-len(part) // 2), len(part)]
            waiting += [(level + 1, part[a:b]) for a, b in reversed(list(zip(cuts, cuts[1:], strict=False)))]


def register(spark: SparkSession) -> None:
    spark.udf.register("parse_html", parse_html_function())
    spark.udtf.register("split_chunks", udtf(SplitChunks, returnType="page_id bigint, chunk_no int, markdown string"))
