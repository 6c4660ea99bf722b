"""Substrings around anchors that very many documents have."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import substrings


def removed(texts, window):
    """Numbers of covered words by the definition."""
    first = {}
    for i, t in sorted(texts.items()):
        w = t.split()
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t in texts.items():
        w = t.split()
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.fixture(scope="module")
def shared():
    rnd = random.Random(5)
    word = lambda: f"w{rnd.getrandbits(24):x}"
    phrase, passage = [word() for _ in range(7)], [word() for _ in range(40)]
    texts = {}
    for i in range(200):  # a phrase too short to be a repeat is in all, a passage in a third, one text in a fifth
        texts[i] = " ".join([*(word() for _ in range(15)), *phrase, *(word() for _ in range(15)), *(passage if i % 3 == 0 else []), word()])
        if i % 5 == 0 and i:
            texts[i] = texts[i - 5]
    return texts


@pytest.mark.parametrize("options", [{}, {"one_in": 1, "times": 2}, {"one_in": 3, "times": 10}, {"one_in": 1, "times": 1}])
def test_results_do_not_depend_on_the_anchors_that_are_spread(spark, shared, options):
    docs = spark.createDataFrame(list(shared.items()), "doc_id bigint, text string").repartition(5)
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substrings.dedup_substrings(docs, **options).collect()}
    assert got == removed(shared, 13)


def test_frequent_anchors_spread(spark):
    rnd = random.Random(6)
    phrase = " ".join(f"p{k}" for k in range(9))  # with windows of nine words or more around it, all different
    texts = [f"{' '.join(f'a{rnd.getrandbits(30):x}' for _ in range(6))} {phrase} {' '.join(f'b{rnd.getrandbits(30):x}' for _ in range(6))}" for _ in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    hot = substrings.frequent_anchors(docs, 13, 5, 10, 40, 2e-5)
    assert 0 < len(hot) < 10
    parts = [(i, 0, 0, t.encode()) for i, t in enumerate(texts)]
    share = {}
    for name, anchors in {"spread": hot, "together": hot[:0]}.items():
        size = [0] * 64
        for row in substrings._packed(parts, 13, 5, 64, anchors):
            size[row[0]] += len(row[6]) // 4
        share[name] = max(size) / sum(size)
    assert share["spread"] < 0.04 < 0.1 < share["together"]  # even shares are 0.016
    assert substrings.frequent_anchors(docs.where(F.lit(False)), 13, 5, 10, 40, 2e-5).size == 0
