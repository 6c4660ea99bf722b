"""Spans that the method adds: precision and recall on planted, loosely written data; nothing that touches a base span."""

import random

import numpy as np

from sparkloom.llm import pii

WORDS = "the order was sent to them and they said that it is there now for all of us today with more to come".split()


def card(rnd):
    digits = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
    return next(digits + d for d in "0123456789" if pii.luhn(digits + d))


def bad_number(rnd):
    while True:
        digits = rnd.choice("123456789") + "".join(rnd.choice("0123456789") for _ in range(15))
        if not pii.luhn(digits):
            return digits


def planted(rnd, kind):
    """(text, the part that is personal data and that the base patterns miss, or None)."""
    ip = ".".join(str(rnd.randint(1, 223)) for _ in range(4))
    phone = f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
    own = card(rnd)
    spelled = f"u{rnd.randint(1, 99)} [at] mail{rnd.randint(1, 9)} [dot] com"
    plain = f"({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
    return [
        (own, None), (phone, None), (ip, None), (f"u{rnd.randint(1, 99)}@mail{rnd.randint(1, 9)}.com", None), (bad_number(rnd), None), (f"version {rnd.randint(1, 9)}.2.3.{rnd.randint(300, 999)}", None),
        (f"{bad_number(rnd)} {own}", own), (f"{phone} {ip}", phone), (f"write to {spelled}", spelled), (f"call {plain}", plain), (f"token {rnd.randint(100, 999)}-{rnd.randint(1000, 9999)}", None),
    ][kind]


def corpus():
    rnd = random.Random(5)
    rows, truth = [], {}
    for i in range(900):
        kind = i % 11
        text, wanted = planted(rnd, kind)
        before, after = (" ".join(rnd.choice(WORDS) for _ in range(8)) for _ in range(2))
        rows.append((i, f"{before} {text} {after}"))
        truth[i] = set()
        if wanted:
            a = rows[-1][1].index(wanted)
            truth[i] = {(a, a + len(wanted))}
    return rows, truth


def test_precision_and_recall_of_added_spans(spark):
    rows, truth = corpus()
    found = {}
    for r in pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        base = {(a, b) for a, b, _ in pii.base_spans(dict(rows)[r.id])}
        spans = {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s}
        assert base <= spans
        found[r.id] = spans - base
    hits = sum(len(found[i] & truth[i]) for i in truth)
    assert hits >= 0.95 * sum(map(len, truth.values()))
    assert hits >= 0.95 * sum(map(len, found.values()))


def test_a_long_base_span_keeps_candidates_out_whatever_is_in_it():
    text = "1.2.3.4.1.2.3.4.1.2.3.4.1.2.3.4.1.2.3.4.415-555-1234@host.example.com and 415-555-1234"
    base = pii.base_spans(text)
    assert sum(k == "ip" for *_, k in base) == 5 and (0, text.index(" "), "email") in base
    for a, b, _, own, *_ in pii.candidates(text, base):
        assert own or a > text.index(" ")


def test_loose_shapes():
    def loose(text):
        return {(text[a:b], k) for a, b, k, own, *_ in pii.candidates(text, pii.base_spans(text)) if not own}

    assert ("4845168114407329", "card") in loose("7536784127813051 4845168114407329")
    assert ("+1 (826) 555-4081", "phone") in loose("+1 (826) 555-4081 190.137.223.204")
    assert ("joe [at] mail [dot] com", "email") in loose("write to joe [at] mail [dot] com")
    assert ("joe @ mail.com", "email") in loose("write to joe @ mail.com")
    assert ("2001:db8::1", "ip") in loose("host 2001:db8::1 is up") and ("10:20:30", "ip") not in loose("at 10:20:30")
    assert loose("") == loose("no data at all") == set()


def test_known_negatives_and_the_classifier():
    soft = pii.estimate([("card", (1, 1, 0), 100), ("card", (-1, 1, 0), 60), ("card", (-1, -1, 0), 90), ("card", (0, 1, 0), 3)])
    assert soft["card", (1, 1, 0)] > 0.9 and soft["card", (-1, 1, 0)] == soft["card", (-1, -1, 0)] == 0
    features = [[0, 1], [0, 2], [0, 1, 3], [0, 2, 3]]
    weights = pii.fit(features, np.array([1.0, 0.0, 1.0, 0.0]), np.ones(4))
    assert [weights[f].sum() > 0 for f in features] == [True, False, True, False]
    assert not pii.fit([], np.zeros(0), np.zeros(0)).any()


def test_overlapping_added_spans_give_way_to_the_likelier():
    weights = np.zeros(len(pii.KINDS) * pii.OF_KIND)
    weights[[5, 6]] = 1.0, 2.0
    spans = [(0, 10, "card", False, [], [5]), (5, 12, "card", False, [], [6]), (12, 20, "phone", False, [], [5]), (30, 40, "ip", True, [], [7]), (50, 60, "ip", False, [], [7])]
    assert pii.chosen(spans, weights) == [(5, 12, "card"), (12, 20, "phone"), (30, 40, "ip")]
