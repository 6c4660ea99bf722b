"""The cumulative-link model: its likelihood, its gradient, its features, and documents that it never saw."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import quality

AT = "/root/testdata/sf0.1"
INSULTS = "trash pathetic idiot worthless disgusting stupid clown loser scum moron".split()


def test_likelihood_by_brute_force():
    rnd = np.random.default_rng(3)
    score, grades, thresholds = rnd.normal(size=50) * 3, rnd.integers(0, 4, 50), np.array([-1.5, 0.2, 0.9])

    def tail(s, k):
        return 1 if k < 0 else 0 if k == 3 else 1 / (1 + math.exp(thresholds[k] - s))

    want = sum(math.log(tail(s, g - 1) - tail(s, g)) for s, g in zip(score, grades, strict=True)) / 50
    got, slope = quality.log_likelihood(score, grades, thresholds)
    assert abs(got - want) < 1e-12
    step = 1e-6
    for i in range(50):  # a row's score moves all its margins
        moved = score.copy()
        moved[i] += step
        assert abs((quality.log_likelihood(moved, grades, thresholds)[0] - got) / step - slope[i].sum()) < 1e-6
    for k in range(3):
        moved = thresholds.copy()
        moved[k] += step
        assert abs((quality.log_likelihood(score, grades, moved)[0] - got) / step + slope[:, k].sum()) < 1e-6


def test_fit_settles_where_the_gradient_vanishes():
    rnd = np.random.default_rng(4)
    rows = [np.flatnonzero(rnd.random(6) < 0.5).astype(np.int32) for _ in range(400)]
    rows = [r if len(r) else np.array([0], np.int32) for r in rows]
    truth = np.array([1.0, -1, 2, 0, 0.5, -2])
    grades = np.digitize([truth[r].sum() + rnd.logistic() for r in rows], [-0.5, 1])
    weights, thresholds = quality.fit(rows, grades, l2=1e-3, steps=3000)
    _, slope = quality.log_likelihood(np.array([weights[r].sum() for r in rows]), grades, thresholds)
    gradient = np.zeros(6)
    for r, d in zip(rows, slope.sum(1), strict=True):
        gradient[r] += d
    assert np.abs(gradient - 1e-3 * weights[:6]).max() < 1e-4 and np.abs(slope.sum(0)).max() < 1e-4
    assert np.corrcoef(weights[:6], truth)[0, 1] > 0.95 and thresholds[0] < thresholds[1]


def test_dependence_by_brute_force():
    rnd = np.random.default_rng(5)
    rows = [np.unique(rnd.integers(0, 8, 4)).astype(np.int32) for _ in range(60)]
    positive = rnd.random(60) < 0.3
    got = quality.dependence(rows, positive)
    for f in range(8):
        have = np.array([f in r for r in rows])
        want = 0
        for a in (True, False):
            for b in (True, False):
                seen, expected = ((have == a) & (positive == b)).sum(), (have == a).sum() * (positive == b).sum() / 60
                want += 2 * seen * math.log(seen / expected) if seen else 0
        assert abs(got[f] - want) < 1e-9
    assert not got[8:].any()


@pytest.fixture(scope="module")
def held_out(spark):
    docs, labels = spark.read.parquet(f"{AT}/documents.parquet"), spark.read.parquet(f"{AT}/labels.parquet")
    seen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2
    model = quality.train(docs, labels.where(seen))
    scored = quality.score(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return [r for r in scored.collect() if zlib.crc32(str(r.id).encode()) % 4 == 2]


def kept(rows, quality_, toxic, insulted=None):
    some = [r.keep for r in rows if (r.quality, r.toxic) == (quality_, toxic) and (insulted is None or insulted == any(w in r.text.lower() for w in INSULTS))]
    return sum(some), len(some)


def test_held_out_documents(held_out):
    clean, junk, both, toxic = (kept(held_out, *x) for x in ((1, 0), (0, 0), (0, 1), (1, 1)))
    insults = kept(held_out, 1, 1, True)
    print("held out, kept of all: clean", clean, "junk", junk, "toxic junk", both, "toxic", toxic, "of these with an insult", insults)
    assert clean[0] >= 0.98 * clean[1] and junk[0] <= 0.05 * junk[1] and both[0] == 0
    assert toxic[0] <= 0.3 * toxic[1] and insults[1] - insults[0] >= 55
