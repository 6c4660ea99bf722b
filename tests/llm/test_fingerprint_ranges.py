"""Successors in order of ids where many rows share an id, have none, or are equal."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ctph


def expected(rows, hashes):
    rows = sorted(((i is not None, i or 0, hashes[t or ""], t or "") for i, t in rows))
    out = Counter()
    for k, (known, i, _, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][3]
        cut = len(text) // 4
        edited = (text[: len(text) - cut] + after[:cut]).encode()
        out[i if known else None, len(text), hashlib.sha256(edited).hexdigest(), ctph.fingerprint(text.encode()), ctph.fingerprint(edited)] += 1
    return out


@pytest.mark.parametrize("kind", ["one id", "no id", "equal rows", "few", "single", "none"])
def test_successors(spark, kind):
    text = lambda i: f"text {i} " * (i % 7 + 1)
    rows = {
        "one id": [(5, text(i)) for i in range(300)] + [(i, text(i)) for i in range(10)],
        "no id": [(None, text(i)) for i in range(300)] + [(-3, "x" * 9), (4, None)],
        "equal rows": [(5, "just the same text")] * 500 + [(None, None)] * 300 + [(i, text(i)) for i in range(-5, 10)],
        "few": [(1, "abcdefgh"), (1, "abcdefgh"), (2, "ijklmnop")],
        "single": [(1, "abcdefgh")],
        "none": [],
    }[kind]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    hashes = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).distinct().collect()}
    got = ctph.compare_with_edited(docs, group_bytes=100).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == (expected(rows, hashes) if rows else Counter())


def test_no_partition_holds_all_rows_of_an_id(spark):
    docs = spark.range(4000).selectExpr("if(id % 2 = 0, 7, null) AS doc_id", "concat('text ', id) AS text")
    sizes = [r["count"] for r in ctph.with_next(docs, group_bytes=2000).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) >= 4000 and max(sizes) < 800
