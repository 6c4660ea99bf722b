"""The source divergence audit against a brute-force version and on odd tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, least=3, top=200):
    docs = [(lang or "", source or "", Counter(t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or ""))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        have = Counter(t for *_, c in mine for t in c)
        kept = sorted(t for t, n in have.items() if n >= least)
        count = {s: Counter() for _, s, _ in mine}
        for _, s, c in mine:
            count[s].update({t: n for t, n in c.items() if have[t] >= least})
        share = {s: {t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept)) for t in kept} for s, c in count.items()}
        whole = sum(count.values(), Counter())
        of_lang = {t: 1 + 10**9 * (whole[t] + 1) // (whole.total() + len(kept)) for t in kept}
        for s in share:
            pairs = [(-sum((p - share[o][t]) ** 2 // share[o][t] for t, p in share[s].items()), o.encode()) for o in share if o != s]
            terms = [(-((p - of_lang[t]) ** 2 // of_lang[t]), t.encode()) for t, p in share[s].items() if count[s][t] and p > of_lang[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    stems = ["in", "inter", "internal", "international", "internationally", "é", "日本語の長い文字列", "Straße", "x" * 70, "x" * 71, "ab", "abcd", "abcde", "ABCDEFGH", "abcdefghi", "naïve", "q"]
    weights = {"s1": 3, "s2": 1, "hot": 9, None: 1, "": 1}
    out = [(" ".join(rnd.choice(stems[: rnd.randint(2, len(stems))]) for _ in range(rnd.randint(0, 30))), rnd.choice(["en", "en", "de", None]), rnd.choices(list(weights), list(weights.values()))[0]) for _ in range(80)]
    return [*out, (None, "en", "s1"), ("", "fr", "alone"), (None, "it", "a"), (" 1 2 ", "it", "b"), ("one two", "pt", "a"), ("one", "pt", "b"), ("y" * 200_000, "de", "s1"), ("z1z_Z", "en", "s2")] + [("y" * 200_000 + " twin", "de", "hot")] * 3


COLUMNS = "text string, lang string, source string"


@pytest.mark.parametrize("size", [1, 400, 8 << 20])
def test_divergence_by_brute_force(spark, rows, size, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_BYTES", size)  # a task gets it with the function
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert got(divergence.divergence(docs, top=4)) == expected(rows, top=4)


def test_first_length_doesnt_matter(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    assert got(divergence.divergence(docs, first=1)) == got(divergence.divergence(docs, first=4)) == got(divergence.divergence(docs, first=64)) == expected(rows)


def test_prefixes_are_counted_by_documents(spark):
    # a prefix in two documents is discarded however many of its terms they hold; in three it stays, its terms don't
    rows = [("abcdex abcdey abcdez", "en", "a")] * 2 + [(f"pqrst{c}", "en", "a") for c in "xyz"]
    assert divergence.kept_terms(spark.createDataFrame(rows, COLUMNS), first=4).collect() == []
    assert {r.term for r in divergence.kept_terms(spark.createDataFrame(rows[:2] * 2, COLUMNS), first=4).collect()} == {b"abcdex", b"abcdey", b"abcdez"}
    block = divergence.counted_block(["en", "en", "de", "en"], ["s", "t", "s", "s"], [b"abcdex Abcdey abcdex", b"abcdex 1", b"none abcdex", None], 4)
    assert {(r["lang"], r["term"]): (r["docs"], [tuple(x.values()) for x in r["by"]]) for r in block.to_pylist()} == {
        ("en", b"abcdex"): ([2, 2], [("s", 2), ("t", 1)]), ("en", b"abcdey"): ([0, 1], [("s", 1)]), ("de", b"none"): ([1], [("s", 1)]), ("de", b"abcdex"): ([1, 1], [("s", 1)]),
    }
    assert divergence.counted_block(["en"], ["s"], [b"1 2"], 4) is None


def test_short_terms_are_counted_once(spark, monkeypatch):
    # terms that the first level completes are summed once: nothing of them is joined or written in between
    made, stage = [], divergence.stage
    monkeypatch.setattr(divergence, "stage", lambda df, *by: made.append(df.columns) or stage(df, *by))
    rows = [("ab cd ab", "en", "s"), ("ab", "en", "t"), ("ab cd", "de", "s"), ("ab", "en", "s"), ("cd", "en", None)]
    found = divergence.kept_terms(spark.createDataFrame(rows, COLUMNS).repartition(4)).collect()
    assert [(r.lang, r.term, [tuple(s) for s in r.by], r.n) for r in found] == [("en", b"ab", [("s", 3), ("t", 1)], 4)]
    assert len(made) == 2


def test_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(8 * 10**17, 9 * 10**17, 5)], "n bigint, total bigint, v bigint")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (8 * 10**17 + 1) // (9 * 10**17 + 5)


def test_odd_and_empty_tables(spark):
    columns = "text string, lang string, source string, doc_id bigint, term int, n int, by int, docs int, prefix int, item int, rank int, value int, part int, complete int, shares int"
    rows = [("a b c", "en", "s", None), ("a b c", "en", "s", None), ("a", None, None, 1), (None, None, None, None), ("b a", "en", None, 1), ("a a tie eit", "en", "t", 1), ("tie eit", "en", "t", 1), ("tie eit", "en", "t", 1)]
    docs = spark.createDataFrame([(*r, *[7] * 11) for r in rows], columns)
    assert got(divergence.divergence(docs)) == expected([r[:3] for r in rows])
    empty = divergence.divergence(docs.where("false"))
    assert empty.collect() == [] and [t for _, t in empty.dtypes] == ["string", "string", "string", "string", "bigint", "int"]
