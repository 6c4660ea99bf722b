"""Spelling variants against a brute-force version and on odd tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = "doc_id bigint, text string"
LETTERS = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def counts(rows, every=31):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def expected(n):
    beside = defaultdict(set)
    names = sorted(n)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if near(a, b):
                beside[a].add(b)
                beside[b].add(a)
    form = {}
    for w in names:
        best = min(beside[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in names:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(beside[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    stems = ["spelling", "aabbccdd", "aaaaaaaaa", "abababababab", "internationally", "straßenbahn", "éèêëéèê", "ÿÀÀÿÀÀÿÀ", "reversedreversed", "×÷×÷×÷×"]
    texts = []
    for level in range(4):  # spellings of spellings, ten times rarer each
        grown = []
        for w in stems if level == 0 else [x for t in texts[-60:] for x in t[:1]]:
            for _ in range(3):
                k = rnd.randrange(len(w) + 1)
                grown.append(rnd.choice([w[:k] + rnd.choice("aábÿ") + w[k:], w[:k] + w[k + 1 :], w[:k] + rnd.choice("aábÿz") + w[k + 1 :]]))
        texts += [(w, 10 ** (3 - level)) for w in (stems if level == 0 else grown[:60])]
    flat = [w for w, n in texts for _ in range(n * 2)]
    rnd.shuffle(flat)
    out = [(i, " ".join(x.upper() if x.isascii() and rnd.random() < 0.1 else x for x in flat[i * 40 : i * 40 + 40])) for i in range(len(flat) // 40 + 1)]
    long = "".join(rnd.choice("abcß") for _ in range(4000))
    return [*out, (None, "spelling,Spelling 1spelling2 日spelling本"), (None, None), (3, ""), (4, f"{long} {long[:9]}x{long[9:]} {long[:-1]}"), (5, f"{long} {long[:9]}x{long[9:]} {long[:-1]}"), (5, f"{long}")]


def test_words_by_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    for every in (31, 2, 1):
        found = {r.word: r.n for r in spelling.words(docs, every=every).collect()}
        assert found == counts(rows, every)


@pytest.mark.parametrize("held", [3, 300_000])
def test_variants_by_brute_force(spark, rows, held, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", held)
    monkeypatch.setattr(spelling, "PAIR_ROWS", held)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    n = counts(rows)
    want = expected(n)
    assert got(spelling.variants(docs)) == want
    assert sum(f is not None for _, f, *_ in want) > 50 and any(f and r != f for _, f, r, *_ in want)


def test_near_words_of_a_full_neighbourhood(spark):
    # everything one step from a word of equal and unequal letters, so each kind of pair is met many times
    rnd = random.Random(2)
    base = ["aaabbba", "abcabcabc"]
    around = {x for w in base for k in range(len(w) + 1) for c in rnd.sample(LETTERS, 12) for x in (w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :])} | set(base)
    n = {w: rnd.choice([2, 3, 30, 300]) for w in sorted(around)}
    ranked = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(n, key=lambda w: (-n[w], w)))], "id bigint, word string").repartition(5)
    found = {r.id: (r.n_near, r.best) for r in spelling.near_words(ranked).collect()}
    names = [r.word for r in ranked.orderBy("id").collect()]
    for i, w in enumerate(names):
        ids = [k for k, v in enumerate(names) if near(w, v)]
        assert found.get(i, (0, None)) == (len(ids), min(ids, default=None)), w


def test_nodes_are_numbered_once(spark):
    rnd = random.Random(4)
    names = sorted({"".join(rnd.choice("abÿ") for _ in range(rnd.randint(7, 14))) for _ in range(400)})
    ranked = spark.createDataFrame(list(enumerate(names)), "id bigint, word string").repartition(6)
    front, back = defaultdict(set), defaultdict(set)
    for r in spelling.node_pairs(ranked).where("kind = 2").withColumn("at", F.monotonically_increasing_id()).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "front", "back"))).alias("p")).collect():
        w = names[r.id]
        assert len(r.p) == len(w) + 1
        for k, p in enumerate(r.p):
            front[p.front].add(w[:k])
            back[p.back].add(w[k:])
    for numbered, paths in ((front, {w[:k] for w in names for k in range(len(w) + 1)}), (back, {w[k:] for w in names for k in range(len(w) + 1)})):
        assert all(len(x) == 1 for x in numbered.values()) and {p for x in numbered.values() for p in x} == paths and len(numbered) == len(paths)


def test_odd_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Spelling spelling", *[7] * 8), (1, "Spelling spelling", *[7] * 8), (None, None, *[7] * 8)], f"{COLUMNS}, word int, n int, id int, best int, form int, up int, front int, kind int")
    assert got(spelling.variants(docs)) == expected(counts([(1, "Spelling spelling")] * 2))
    empty = spelling.variants(docs.where("false"))
    assert empty.collect() == [] and dict(empty.dtypes)["form_n"] == "bigint"
