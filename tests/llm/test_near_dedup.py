"""Near-dedup of the pipeline: texts that share an id, blanks, and links that no leader shows."""

import random

import numpy as np

from sparkloom.llm import simhash


def words(seed, n):
    rnd = random.Random(seed)
    return [f"w{rnd.getrandbits(40):x}" for _ in range(n)]


def test_each_text_of_a_repeated_id_links(spark):
    near = words(1, 120)
    copy = [*near]
    copy[60] = "changed"
    for other in (words(2, 50), words(3, 50), words(4, 50)):
        rows = [(5, " ".join(near)), (5, " ".join(other)), (7, " ".join(copy)), (8, " ".join(copy)), (3, " ".join(words(9, 40))), (None, " ".join(near))]
        kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in rows if i not in (7, 8))


def test_one_text_of_an_id_may_go_alone(spark):
    near = words(1, 120)
    copy = [*near]
    copy[60] = "changed"
    rows = [(2, " ".join(near)), (5, " ".join(copy)), (5, " ".join(words(2, 50))), (6, ""), (9, None)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[0], rows[2], rows[3]])


def test_groups_around_the_limit_are_those_of_exact_similarity(spark):
    rnd = random.Random(3)
    base, texts = words(7, 150), []
    for i in range(250):  # copies with up to eight changes of one base: some link to it, some over others, some not at all
        w = [*base]
        for k in rnd.sample(range(5, 145), rnd.randint(0, 8)):
            w[k] = f"x{i}y{k}"
        texts.append(" ".join(w))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert kept == {i for i in range(len(texts)) if find(i) == i} and 10 < len(kept) < 200


def test_wide_fingerprints_are_majorities():
    hashes = simhash.shingle_hashes(" ".join(words(5, 700)).encode(), 5)
    first = simhash.wide_fingerprint(hashes)[0] & (1 << 64) - 1
    assert first == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))
    assert len(set(simhash.wide_fingerprint(hashes))) == simhash.WIDE
    assert simhash.wide_fingerprint(np.zeros(0, np.uint64)) == (0,) * simhash.WIDE


def test_components_arent_made_anew_from_all_links(spark, monkeypatch):
    # a chain of copies that no leader joins in one round: links of earlier rounds come as one edge for each node
    texts, w = [], words(11, 150)
    for i in range(40):
        w = [*w[3:], *words(100 + i, 3)]
        texts.append(" ".join(w))
    seen, whole = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda edges: seen.append(edges) or whole(edges))
    kept = [r.doc_id for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()]
    assert kept == [0] and len(seen) <= 2


def test_a_single_round_keeps_components(spark):
    rnd = random.Random(8)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)]
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    components = lambda x: sorted(tuple(r) for r in simhash.connected_components(x).collect())
    once = simhash.drawn_together(frame)
    assert once.where("u <= v").count() == 0 and components(once) == components(frame)
