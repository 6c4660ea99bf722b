"""Near-dedup loses no pair of the similarity asked for, whatever its fingerprints and bands say."""

import random

import numpy as np

from sparkloom.llm import simhash


def words(seed, n):
    rnd = random.Random(seed)
    return [f"w{rnd.getrandbits(40):x}" for _ in range(n)]


def test_short_texts_of_exactly_the_similarity_link(spark):
    # five shingles and four of them: fingerprints differ in 192 of 1,024 bits on average, two more than were admitted
    rows = [(2 * i + k, " ".join(words(i, 9)[: 9 - k])) for i in range(60) for k in (0, 1)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [2 * i for i in range(60)]


def test_prefixes_alone_lose_no_pair(spark):
    # texts of one common passage, and of one base with changes, around the limit
    rnd, base, passage, texts = random.Random(4), words(7, 150), words(8, 40), []
    for i in range(120):
        w = [*base]
        for k in rnd.sample(range(5, 145), rnd.randint(0, 8)):
            w[k] = f"x{i}y{k}"
        texts.append(" ".join(w))
    texts += [" ".join([*passage, *words(500 + i, 1 + i % 30)]) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    common = simhash.common_shingles(docs, one_in=2)
    assert common.any()
    rows = simhash.wide_fingerprints(docs, 0.8, common).withColumnRenamed("id", "node")
    found = {(r.a, r.b) for r in simhash.unjoined(rows, None, 0.8).collect()}
    alike = {(j, i) for i, a in enumerate(sets) for j in range(i) if len(a & sets[j]) >= 0.8 * len(a | sets[j])}
    equal = {(j, i) for j, i in alike if sets[i] == sets[j]}
    assert alike <= found | equal and len(alike) > 300


def test_prefixes_of_similar_sets_meet():
    rnd = np.random.default_rng(3)
    common = rnd.random(1 << simhash.PLACES) < 0.3
    for _ in range(300):
        both, a, b = (rnd.integers(0, 1 << 63, rnd.integers(x, y), np.uint64) for x, y in ((1, 60), (0, 9), (0, 9)))
        a, b = np.unique(np.concatenate((both, a))), np.unique(np.concatenate((both, b)))
        if len(both) >= 0.8 * (len(a) + len(b) - len(both)):
            assert np.intersect1d(simhash.prefix(a, 0.8, common), simhash.prefix(b, 0.8, common)).size
