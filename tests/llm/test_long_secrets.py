"""Findings of any length are found and looked at whole."""

from sparkloom.llm import secrets

KINDS = [*"abcdefghijklmnopqrstuvwxyz", "0", "A", "*"]
MOVES = {a + b: -1.0 for a in KINDS for b in KINDS}


def test_dictionary_coverage_of_the_whole_finding():
    value = "-".join(["wordy"] * 2000)
    covered = secrets.describe(value, 0, len(value), "", MOVES, frozenset(["wordy"]))[3]
    assert covered == 2000 * 5 / len(value)


def test_assigned_values_of_any_length():
    value = "!?" * 300
    text = f'password = "{value}"'
    assert [(text[a:b], rule) for a, b, rule, _ in secrets.findings(text)] == [(value, "assigned")]
