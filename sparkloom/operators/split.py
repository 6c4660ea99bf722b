"""Splitting pages' Markdown into chunks of bounded size.

A chunk that is too large is cut before each node of the first kind in the order h1 to h6, list, table, code; what is
still too large is cut at the next kind, and at last in halves. A single node is never cut.

:func:`split_nodes` goes by sizes that add up: every level is a window over the nodes of a page, and the number of halvings
follows from the largest chunk's number of nodes. :func:`split_when` takes any test of a chunk's Markdown: chunks that fail
it are a table that is cut, rendered and tested again, until none is left; a chunk that passes is in no later round.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .markdown import Options, blocks, joined_blocks, rendered_blocks

# The kinds of nodes to cut at, in order.
LEVELS = ["h1", "h2", "h3", "h4", "h5", "h6", "list", "table", "code"]


def top_nodes(nodes: DataFrame, options: Options = Options()) -> DataFrame:
    """(page_id, place, node, markdown): the page's outermost blocks; a list or quote is one."""
    found = rendered_blocks(blocks(nodes, options))
    each = found.groupBy("page_id", "root", "top").agg(F.min("run").alias("run"), F.first("node").alias("node"), joined_blocks().alias("markdown"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("root", "run"))
    return each.select("page_id", place.alias("place"), "node", F.regexp_replace("markdown", r"\n\z", "").alias("markdown"))


def split_nodes(nodes: DataFrame, most: int, size: Callable[[Column], Column] = F.length) -> DataFrame:
    """(page_id, chunk_no, markdown) from the rows of :func:`top_nodes`.

    ``size`` measures a node's Markdown (characters, or tokens); the line ends between nodes count as well. A chunk of
    more than ``most`` is cut as long as it has more than one node.
    """
    rows = nodes.withColumn("size", size(F.col("markdown"))).withColumn("chunk", F.lit(1))
    own = Window.partitionBy("page_id", "chunk")
    line = own.orderBy("place")

    def cut(rows: DataFrame, here: Callable[[Column], Column]) -> DataFrame:
        n = F.count("*").over(own)
        over = (F.sum(F.col("size") + 2).over(own) - 1 > most) & (n > 1)
        rows = rows.withColumns({"_over": over, "_n": n, "_k": F.row_number().over(line)})
        return rows.withColumn("chunk", F.coalesce(F.max(F.when(F.col("_over") & here(F.col("_n")), F.col("place"))).over(line), F.col("chunk"))).drop("_over", "_n", "_k")

    for level in LEVELS:
        rows = cut(rows, lambda n, level=level: F.col("node") == level)
    rows = stage(rows)
    widest = rows.groupBy("page_id", "chunk").count().agg(F.max("count")).first()[0] or 1
    for _ in range(ceil(log2(widest)) if widest > 1 else 0):
        rows = cut(rows, lambda n: F.col("_k") == F.ceil(n / 2) + 1)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("place", "markdown"))), lambda x: x["markdown"])
    text = F.concat(F.array_join(pieces, "\n\n"), F.lit("\n"))
    chunks = rows.groupBy("page_id", "chunk").agg(text.alias("markdown"))
    return chunks.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("chunk")).alias("chunk_no"), "markdown")


def split_when(nodes: DataFrame, fits: Callable[[Column], Column], shared_cursor: bool = False) -> DataFrame:
    """(page_id, chunk_no, markdown) from the rows of :func:`top_nodes`: chunks whose Markdown fits, or that are one node.

    ``fits`` makes a condition of the chunk's Markdown: of its length, its tokens, or a user's function. A chunk that a
    kind of node doesn't occur in is tested at the next kind, as it is. With ``shared_cursor`` the chunks of a page that
    are cut in one round take the kinds from one sequence, each the next one, in the order of the page; otherwise each
    chunk goes on from the kind that it came from.
    """
    part = F.struct("place", "node", "markdown")
    open_ = nodes.groupBy("page_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).withColumn("level", F.lit(0))
    kinds, rounds = F.array(*map(F.lit, LEVELS)), []
    own = Window.partitionBy("page_id")
    while True:
        text = F.concat(F.array_join(F.transform("parts", lambda p: p["markdown"]), "\n\n"), F.lit("\n"))
        tested = open_.withColumn("markdown", text).withColumn("done", F.coalesce(fits(F.col("markdown")), F.lit(False)) | (F.size("parts") == 1))
        tested = stage(tested, "done")
        rounds.append(tested.where("done").select("page_id", F.get("parts", F.lit(0))["place"].alias("place"), "markdown"))
        rest = tested.where("not done").select("page_id", "parts", "level")
        if not rest.head(1):
            break
        after = F.col("level") + 1
        if shared_cursor:
            first = F.get("parts", F.lit(0))["place"]
            rest = rest.withColumn("_all", F.count("*").over(own)).withColumn("level", F.col("level") + F.row_number().over(own.orderBy(first)) - 1)
            after = F.col("_next")
            # the next round of the page begins where this one ends
            rest = rest.withColumn("_next", F.min("level").over(own) + F.col("_all"))
        kind, n = F.get(kinds, F.col("level")), F.size("parts")
        starts = F.when(kind.isNotNull(), F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("parts", i)["node"] == kind))).otherwise(F.array(F.lit(0), F.ceil(n / 2).cast("int")))
        rest = rest.withColumn("starts", starts)
        cut = F.transform("starts", lambda s, k: F.slice("parts", s + 1, F.coalesce(F.get("starts", k + 1), n) - s))
        open_ = rest.select("page_id", F.explode(cut).alias("parts"), after.cast("int").alias("level"))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionAll(more)
    return out.select("page_id", F.row_number().over(own.orderBy("place")).alias("chunk_no"), "markdown")


def slices_of(items: str | Column, size: int) -> Column:
    """An array's consecutive slices of ``size`` elements."""
    column = F.col(items) if isinstance(items, str) else items
    starts = F.when(F.size(column) > 0, F.sequence(F.lit(1), F.size(column), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(column, i, size))
