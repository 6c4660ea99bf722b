"""Quality rules with adaptive thresholds against a brute-force version, on labelled documents and on odd tables."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from sparkloom.llm import common, rules

WORD, SYMBOL = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")
COLUMNS = "doc_id bigint, text string, lang string, source string"


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), len(covered)


def expected(rows, least):
    """Base and verdict of each row, with sorted lists for sketches."""
    quotients = {"word_length": (1, 0), "symbols": (2, 0), "repeated_lines": (4, 3), "repeated_words": (5, 0)}
    docs = []
    for i, text, lang, source in rows:
        m = measures(text)
        failed = m[0] < 50 or 100 * m[5] > 50 * m[0]
        docs.append((i, lang or "", source or "", m, failed, {} if failed else {f: 1000 * m[a] // m[b] for f, (a, b) in quotients.items()}))
    floor = lambda v: v >> max(0, v.bit_length() - 8) << max(0, v.bit_length() - 8)
    out = []
    for i, lang, source, m, failed, figures in docs:
        broken = []
        for f in figures:
            scopes = ([d[5][f] for d in docs if d[5] and d[1] == lang and (d[2] == source or k) or d[5] and k == 2] for k in range(3))
            values = sorted(map(floor, next(s for k, s in enumerate(scopes) if len(s) >= least or k == 2)))
            q1, q2, q3 = (values[-(-k * len(values) // 4) - 1] for k in (1, 2, 3))
            width = 4 * min(q2 - q1, q3 - q2) + rules.SLACK[f]
            if figures[f] > q2 + width or f == "word_length" and figures[f] < q2 - width:
                broken.append(f)
        out.append((i, *m, failed, ",".join(broken), not failed and not broken))
    return sorted(out, key=repr)


def text_of(rnd):
    kind = rnd.random()
    words = ["".join(rnd.choice("abcdeé日") for _ in range(rnd.randint(1, 8))) for _ in range(rnd.randint(1, 400))]
    if kind < 0.1:
        words = [w + rnd.choice("***%%#") * 3 for w in words]
    elif kind < 0.2:
        words = [w * 3 for w in words]
    elif kind < 0.3:
        words = words[: rnd.randint(1, 30)] * 6
    return "".join(w + rnd.choice(["", " ", " ", "  ", "\n", "\t", "\r\n", " ", "\x0b"]) for w in words)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = [(i, text_of(rnd), rnd.choice(["en", "en", "de", None]), rnd.choice(["a", "a", "a", "b", None])) for i in range(250)]
    return [*out, (250, None, "en", "a"), (251, "", "fr", "a"), (252, " \n\n", "en", "b"), (253, "only " * 60, "it", "z"), (254, " ".join(f"w{k % 7000}" for k in range(20_000)), "en", "a"), (254, out[0][1], "en", "a"), (None, out[0][1], "en", "a"), (None, out[0][1], "en", "a")]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [1, 30, 10_000])
def test_verdicts_by_brute_force(spark, rows, least):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    assert found(rules.judge(docs, least=least)) == expected(rows, least)


def test_measures_in_slices(monkeypatch, rows):
    texts = [t for _, t, *_ in rows]
    whole = rules._measures(pa.array(texts, pa.string()))
    assert [tuple(x.values()) for x in whole.to_pylist()] == [measures(t) for t in texts]
    monkeypatch.setattr(rules, "slices", lambda sizes: common.slices(sizes, 100))
    assert rules._measures(pa.array(texts, pa.string())).equals(whole)
    assert len(rules._measures(pa.array([], pa.string()))) == 0


def test_sketches_merge(spark, rows):
    docs = spark.createDataFrame(rows, COLUMNS)
    m = docs.selectExpr("coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "text").withColumn("m", rules.measures(docs["text"]))
    counts = Counter()
    for r in rules.sketches(m).collect():
        counts[r.scope, r.figure] += r.n
    sound = sum(not x[7] for x in expected(rows, 1))
    assert set(counts.values()) == {sound} and len(counts) == 12


def test_labelled_documents(spark):
    at = "/root/testdata/sf0.1"
    got = rules.judge(spark.read.parquet(f"{at}/documents.parquet")).join(spark.read.parquet(f"{at}/labels.parquet").withColumnRenamed("doc_id", "id"), "id").where("toxic = 0")
    clean = got.where("quality = 1 and not base_failed").selectExpr("avg(int(kept))").first()[0]
    junk = got.where("quality = 0").selectExpr("avg(int(kept))").first()[0]
    by_rules = got.where("quality = 0 and not base_failed").selectExpr("avg(int(kept))", "count(*)").first()
    assert clean > 0.995 and junk < 0.01 and by_rules[0] < 0.01 and by_rules[1] > 200


def test_odd_and_empty_tables(spark, rows):
    extra = "m int, own int, whole int, salt int, low_symbols int, high_symbols int, total int, figure int, bin int, n_words int, kept int, rules int, id int, row int"
    docs = spark.createDataFrame([(*r, *[7] * 14) for r in rows], f"{COLUMNS}, {extra}")
    assert found(rules.judge(docs, least=30)) == expected(rows, 30)
    kept = rules.select(docs, least=30)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.select("doc_id").collect())) == sorted(f"Row(doc_id={x[0]})" for x in expected(rows, 30) if x[-1])
    for df in (rules.judge(docs.where("false")), rules.select(docs.where("false"))):
        assert df.collect() == []
    short = docs.where("doc_id = 250 or doc_id = 251")
    assert {r.base_failed for r in rules.judge(short).collect()} == {True}
