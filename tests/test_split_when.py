"""Chunks by any test of their Markdown against a recursive version."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.split import LEVELS, split_when

COLUMNS = "page_id long, place int, node string, markdown string"


def tokens(text):
    return len(text.split())


def by_branch(nodes, most, level=0):
    text = "\n\n".join(m for _, m in nodes) + "\n"
    if tokens(text) <= most or len(nodes) == 1:
        return [text]
    return [t for part in parts(nodes, level) for t in by_branch(part, most, level + 1)]


def parts(nodes, level):
    if level >= len(LEVELS):
        half = -(-len(nodes) // 2)
        return [nodes[:half], nodes[half:]]
    out = []
    for n in nodes:
        if not out or n[0] == LEVELS[level]:
            out.append([])
        out[-1].append(n)
    return out


def by_cursor(nodes, most):
    """Breadth first: of each round's chunks those that are cut take the next kinds in turn."""
    tree, level = [nodes], 0
    done = {}
    while tree:
        following = []
        for part in tree:
            text = "\n\n".join(m for _, m in part) + "\n"
            if tokens(text) <= most or len(part) == 1:
                done[id(part[0])] = (part, text)
            else:
                following += parts(part, level)
                level += 1
        tree = following
    order = {id(n): k for k, n in enumerate(nodes)}
    return [text for _, (_, text) in sorted(done.items(), key=lambda x: order[x[0]])]


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(21)
    out = {}
    for p in range(25):
        n = rnd.choice([1, 2, 7, 20, 60])
        out[p] = [(rnd.choice([*LEVELS, "paragraph", "paragraph", "paragraph", "blockquote"]), " ".join("w" for _ in range(rnd.randint(1, 30)))) for _ in range(n)]
    out[100] = [("paragraph", "x " * 9)] * 33  # halves only
    out[100] = [(k, f"{m}{i}") for i, (k, m) in enumerate(out[100])]
    return out


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("most", [0, 40, 10_000])
def test_chunks_by_recursion(spark, pages, most, shared):
    rows = [(p, k, node, text) for p, nodes in pages.items() for k, (node, text) in enumerate(nodes, 1)]
    words = lambda text: F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) <= most
    found = split_when(spark.createDataFrame(rows, COLUMNS).repartition(3), words, shared)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.page_id, r.chunk_no)):
        got.setdefault(r.page_id, []).append(r.markdown)
    assert got == {p: (by_cursor if shared else by_branch)(nodes, most) for p, nodes in pages.items()}


def test_a_users_function_and_empty_tables(spark):
    @F.udf("boolean")
    def even(text):
        return len(text) % 2 == 0

    rows = spark.createDataFrame([(1, 1, "h1", "ab"), (1, 2, "h1", "abc"), (None, 1, "code", "a")], COLUMNS)
    assert sorted(((r.page_id or 0, r.chunk_no, r.markdown) for r in split_when(rows, even).collect())) == [(0, 1, "a\n"), (1, 1, "ab\n\nabc\n")]
    assert split_when(rows.where("false"), even).collect() == []
