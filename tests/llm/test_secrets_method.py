"""The forest on labels that no rule gives, statistics over all words, and held-out findings."""

import math
import random
import zlib
from collections import Counter

from sparkloom.llm import secrets

WORDS = "alpha beta gamma delta epsilon kappa lambda omicron sigma upsilon".split()


def corpus():
    """Quoted values under one and the same neutral name: random ones are secrets, words strung together aren't."""
    rnd = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        real = i % 2 == 0
        value = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(22)) if real else rnd.choice("_-.").join([rnd.choice(WORDS) + str(rnd.randrange(9)) for _ in range(3)])
        text = f'{" ".join(rnd.choice(WORDS) for _ in range(30))} setting = "{value}" {" ".join(rnd.choice(WORDS) for _ in range(5))}'
        rows.append((i, text, "src/a"))
        marks.append((i, text.index(value), int(real)))
    return rows, marks


def test_forest_tells_apart_what_the_rules_do_not(spark):
    rows, marks = corpus()
    truth = {(i, a): bool(x) for i, a, x in marks}
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = secrets.scan(table, spark.createDataFrame(marks, "doc_id bigint, start bigint, secret int"), rate=1e-3).collect()
    ruled = [secrets.rule_label(rows[r.doc_id][1][r.start : r.end], r.rule, r.name) for r in got]
    assert ruled.count(None) >= 0.98 * len(got)
    held = [r for r in got if r.held_out and (r.doc_id, r.start) in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 50 and sum(r.secret == truth[r.doc_id, r.start] for r in held) >= 0.95 * len(held)


def test_statistics_are_of_all_words(spark):
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 14))) for _ in range(50)) for _ in range(40)] + ["été X9 a", None, ""]
    counts = secrets.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    words = Counter(w for t in texts if t for w in t.lower().split() if len(w) >= 2 and w.isalpha())
    assert {r.word: r.n for r in counts.collect()} == words
    pairs = Counter()
    for w, n in words.items():
        for a, b in zip(w, w[1:], strict=False):
            pairs[secrets._class(a) + secrets._class(b)] += n
    moves = secrets.transitions(counts)
    for a in secrets.KINDS:
        total = sum(pairs[a + b] for b in secrets.KINDS)
        for b in secrets.KINDS:
            assert math.isclose(moves[a + b], math.log((pairs[a + b] + 1) / (total + len(secrets.KINDS))))
    rate = 2 / sum(words.values())
    assert secrets.dictionary(counts, rate) == {w for w, n in words.items() if 4 <= len(w) <= 12 and n >= 2}


def test_no_labels_or_one_kind_of_them(spark):
    table = spark.createDataFrame([(1, "order 1234567890123456 x", None), (3, None, "a"), (5, 'x = "quitenormal words"', "b"), (7, 'key: "a1b2c3d4e5"', "b")], "doc_id bigint, text string, source string")
    got = {(r.doc_id, r.rule): (r.p_secret, r.secret, r.label) for r in secrets.scan(table).collect()}
    assert got == {(1, "run"): (0.0, False, 0.0), (7, "assigned"): (1.0, True, None)}
