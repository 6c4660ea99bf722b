"""Tables, partitions and Arrow batches that hold short or empty texts only."""

import hashlib

import pytest

from sparkloom.llm import substrings


def expected(rows):
    """Rows by definition: words of windows that a smaller id also has are removed."""
    windows = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 12):
            windows[tuple(w[k : k + 13])] = min(i, windows.get(tuple(w[k : k + 13]), i))
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - 12) if windows[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


LONG = " ".join(f"w{k}" for k in range(40))
TABLES = {
    "one short text": [(1, "a b")],
    "one empty text": [(1, "")],
    "one null": [(1, None)],
    "short ones only": [(i, "x " * (i % 12)) for i in range(30)],
    "short ones among long ones": [(i, LONG if i % 7 == 0 else "a b c" if i % 2 else "") for i in range(40)],
    "all windows repeat in one slice": [(i, LONG) for i in range(5)] + [(9, None)],
}


@pytest.mark.parametrize("batch", [1, 7, 10_000])
@pytest.mark.parametrize("name", TABLES)
def test_short_texts(spark, name, batch):
    rows = TABLES[name]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id"), digest=True)
        assert sorted(map(tuple, found.collect())) == expected(rows)
    finally:
        spark.conf.set(key, before)
