"""Exact substring deduplication by seed and extend.

A window is ``window`` consecutive words of one text. Its seeds are all runs of ``seed`` words inside it; the one with
the smallest hash (the leftmost of equals) is its anchor, which is winnowing: equal windows pick equal anchors, and
neighbouring windows mostly share one. Each map task packs, for slices of text, the anchors and the 48-bit hashes of
the windows around them into one binary row per bucket of the anchors' hash, so the shuffle carries few, large rows.
A bucket joins documents on equal anchors, drops anchors of a single document, and extends each anchor both ways over
the windows that hold it; windows that an earlier document also has are repeats, and runs of them are joined to maximal
repeats of ``window`` words or more. A window is told apart by its anchor (32 bits and its bucket) and its own hash.

Before the shuffle a slice decides what it can itself: of equal windows in it only those of the smallest id are sent.
So a passage that a third of all documents share costs one row's entry for each slice of text, not for each document.

A short run of words may be the anchor in very many documents whose windows around it all differ. Such anchors are
found in a sample of the texts, and their windows go to buckets by their own hash, one by one, so they spread over all
buckets. The sample decides on places only: equal windows have equal anchors and meet in any case.

Defined cases: null text has no words; rows without an id are neither sources of repeats nor cleaned; rows of one id
don't clean one another; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, partitions, slices, small_batches, utf8

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Words that one numpy step takes of a text longer than a slice.
PIECE_WORDS = SLICE_BYTES // 6
PACK = "bucket int, doc binary, copy binary, start binary, count binary, anchor binary, low binary, high binary, done boolean"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses, n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 4096)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it."""
    edge = np.diff(np.r_[True, WHITE[data], True].view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _power(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum(LETTER[data] * power[:-1], dtype=np.uint64)]
    return _mix((total[end] - total[begin]) * inverse[begin])


def _rolled(h: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n if len(out) else 0):
        out = out * factor + h[j : j + len(out)]
    return _mix(out)


def _pieces(doc: int, copy: int, text: bytes, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(doc, copy, number of its first word, bytes): long texts in parts that overlap by window - 1 words."""
    if len(text) <= SLICE_BYTES:
        yield doc, copy, 0, text
        return
    begin, end = word_bounds(np.frombuffer(text, np.uint8))
    for i in range(0, max(1, len(begin) - window + 1), PIECE_WORDS):
        last = min(len(begin), i + PIECE_WORDS + window - 1) - 1
        yield doc, copy, i, text[begin[i] : end[last]] if len(begin) else b""


def windows(parts: list[tuple[int, int, int, bytes]], window: int, seed: int) -> tuple[np.ndarray, ...]:
    """For each window of the parts: index of its part, its first word's number there, anchor hash, place of the anchor, window hash."""
    data = np.frombuffer(b"\n".join(p[3] for p in parts) + b"\n", np.uint8)
    begin, end = word_bounds(data)
    h = word_hashes(data, begin, end)
    offset = np.cumsum([0, *(len(p[3]) + 1 for p in parts)])
    of = np.searchsorted(offset, begin, side="right") - 1
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    whole = _rolled(h, window, STEP)
    seeds = _rolled(h, seed, np.uint64(BASE))
    best, at = seeds[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - seed + 1):
        other = seeds[j : j + n]
        less = other < best
        best[less], at[less] = other[less], j
    first = np.searchsorted(of, np.arange(len(parts)))  # number of each part's first word
    good = np.flatnonzero(of[:n] == of[window - 1 :])
    return of[good], good - first[of[good]], best[good], good + at[good], whole[good]


def _later(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller doc has the same key."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    out = np.zeros(len(key), bool)
    if len(k):
        least = np.minimum.reduceat(doc[order], starts)
        out[order] = doc[order] > np.repeat(least, np.diff(np.r_[starts, len(k)]))
    return out


def _runs(doc: np.ndarray, copy: np.ndarray, start: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """First index of each run of neighbouring windows of one text with equal ``more``."""
    if not len(doc):
        return np.zeros(0, np.int64)
    new = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] != start[:-1] + 1)
    for x in more:
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.r_[True, new])


def _packed(parts: list[tuple[int, int, int, bytes]], window: int, seed: int, buckets: int, hot: np.ndarray) -> Iterator[tuple]:
    part, start, anchor, place, whole = windows(parts, window, seed)
    doc = np.array([p[0] for p in parts], np.int64)[part]
    copy = np.array([p[1] for p in parts], np.int64)[part]
    start = start + np.array([p[2] for p in parts], np.int64)[part]
    gone = _later(whole, doc)
    if gone.any():
        d, c, s = doc[gone], copy[gone], start[gone]
        runs = _runs(d, c, s)
        n = np.diff(np.r_[runs, len(d)])
        # the slice has decided these; any bucket may pass them on
        yield int(d[0] % buckets), d[runs].tobytes(), c[runs].tobytes(), s[runs].astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes(), b"", b"", b"", True
        doc, copy, start, anchor, place, whole = (x[~gone] for x in (doc, copy, start, anchor, place, whole))
    if not len(doc):  # texts without a window, or all decided
        return
    alone = np.isin(anchor, hot)
    runs = _runs(doc, copy, start, place, np.where(alone, np.arange(len(doc)), -1))
    n = np.diff(np.r_[runs, len(doc)])
    by = np.where(alone[runs], whole[runs] >> np.uint64(16), anchor[runs] & np.uint64(0xFFFFFFFF))
    bucket = (by % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    runs, n, bucket = runs[order], n[order], bucket[order]
    ends = np.cumsum(n)
    index = np.repeat(runs - (ends - n), n) + np.arange(len(whole))  # windows in the order of the runs
    whole = whole[index]
    low, high = (whole & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((whole >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)
    d, c, s, a = doc[runs], copy[runs], start[runs].astype(np.uint32), (anchor[runs] >> np.uint64(32)).astype(np.uint32)
    n = n.astype(np.uint32)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
    for i, j in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        w = slice(int(ends[i] - n[i]), int(ends[j - 1]))
        yield int(bucket[i]), d[i:j].tobytes(), c[i:j].tobytes(), s[i:j].tobytes(), n[i:j].tobytes(), a[i:j].tobytes(), low[w].tobytes(), high[w].tobytes(), False


def _matched(table: pa.Table) -> pa.Table:
    """Runs of windows of one bucket that an earlier document has too."""
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    kinds = {"doc": np.int64, "copy": np.int64, "start": np.uint32, "count": np.uint32, "anchor": np.uint32, "low": np.uint32, "high": np.uint16}

    def read(name: str, done: bool) -> np.ndarray:
        return np.frombuffer(b"".join(x for x, d in zip(columns[name], columns["done"], strict=True) if d is done), kinds[name])

    doc, copy, start, count = (read(x, True) for x in ("doc", "copy", "start", "count"))
    out = [(doc, copy, start.astype(np.int64), count.astype(np.int64))]
    doc, copy, start, count, anchor, low, high = (read(x, False) for x in kinds)
    if len(doc):
        distinct, seed = np.unique(anchor, return_inverse=True)
        least, most = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
        np.minimum.at(least, seed, doc)
        np.maximum.at(most, seed, doc)
        shared = (least != most)[seed]
        ends = np.cumsum(count, dtype=np.int64)
        doc, copy, start, anchor, size, begin = (x[shared] for x in (doc, copy, start.astype(np.int64), anchor, count.astype(np.int64), ends - count))
        if len(doc):
            each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(begin, size) + each
            key = (low[at].astype(np.uint64) | (high[at].astype(np.uint64) << np.uint64(32))) * STEP + _mix(np.repeat(anchor, size).astype(np.uint64) + np.uint64(1))
            d, c, s = np.repeat(doc, size), np.repeat(copy, size), np.repeat(start, size) + each
            hit = _later(key, d)
            d, c, s = d[hit], c[hit], s[hit]
            runs = _runs(d, c, s)
            out.append((d[runs], c[runs], s[runs], np.diff(np.r_[runs, len(d)])))
    return pa.table({name: pa.array(np.concatenate(x)) for name, x in zip(("doc", "copy", "start", "count"), zip(*out, strict=True), strict=True)})


def frequent_anchors(rows: DataFrame, window: int, seed: int, one_in: int, times: int, share: float) -> np.ndarray:
    """Hashes of the anchors that ``times`` or more, and ``share``, of the sampled texts have; one text in ``one_in`` is sampled.

    So they are at most 1 / share times as many as a text has anchors on average.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [p for k, t in enumerate(utf8(batch.column(0))) for p in _pieces(k, 0, t, window)]
            for a, b in slices([len(p[3]) for p in parts]):
                part, _, anchor, _, _ = windows(parts[a:b], window, seed)
                pairs = np.unique(np.stack([part.astype(np.uint64), anchor]), axis=1)[1]
                yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64))], names=["anchor"])

    sample = rows.where(F.pmod(F.xxhash64("doc", "text"), F.lit(one_in)) == 0).select("text")
    least = max(times, share * sample.count())
    found = sample.mapInArrow(run, "anchor bigint").groupBy("anchor").count().where(F.col("count") >= least).collect()
    return np.array([r["anchor"] for r in found], np.int64).view(np.uint64)


def repeats(docs: DataFrame, window: int = 13, seed: int = 5, bucket_bytes: int = 16 << 20, one_in: int = 1000, times: int = 40, share: float = 2e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, copy, start, count): runs of ``count`` windows from word ``start`` on that a smaller id also has.

    copy is xxhash64 of the text, which tells rows of one id apart. Runs of one text may touch and are joined by
    :func:`maximal_repeats`. A bucket is a task's work and holds about what
    ``bucket_bytes`` of text give. ``one_in``, ``times`` and ``share``
    say which anchors are spread (:func:`frequent_anchors`); results don't depend on them.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-total // bucket_bytes))
    hot = frequent_anchors(rows, window, seed, one_in, times, share)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACK.split(", ")]
        kinds = [pa.int32(), *[pa.binary()] * 7, pa.bool_()]
        for batch in batches:
            parts = [p for d, c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True) for p in _pieces(d, c, t, window)]
            for a, b in slices([len(p[3]) for p in parts]):
                found = list(_packed(parts[a:b], window, seed, buckets, hot))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    packed = rows.select("doc", F.xxhash64("text").alias("copy"), "text").mapInArrow(pack, PACK)
    return packed.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_matched, "doc bigint, copy bigint, start bigint, count bigint")


def _cover(found: list, window: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted((x["start"], x["start"] + x["count"] + window - 1) for x in found or ()):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _with_repeats(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(id, text, found): found lists the runs of repeated windows; null if there are none."""
    found = repeats(docs, id_col=id_col, text_col=text_col, **options).groupBy("doc", "copy").agg(F.collect_list(F.struct("start", "count")).alias("found"))
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"doc": F.col("id").cast("bigint"), "copy": F.xxhash64("text")})
    return rows.join(found, ["doc", "copy"], "left").select("id", "text", "found")


def maximal_repeats(docs: DataFrame, window: int = 13, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, start, end): the repeats themselves, as word numbers with an exclusive end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, a, b) for i, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, b in _cover(f, window)]
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "start", "end"), x, strict=True)) for x in out], schema=pa.schema([("id", batch.schema.field(0).type), ("start", pa.int64()), ("end", pa.int64())]))

    rows = _with_repeats(docs, id_col, text_col, window=window, seed=seed, **options).where("found is not null").select("id", "found")
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, start bigint, end bigint")


def dedup_substrings(docs: DataFrame, window: int = 13, seed: int = 5, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_removed, kept): kept holds the other words joined by one space; with ``digest`` its SHA-256 is kept_sha256.

    Further options are those of :func:`repeats`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_n, removed, kept = [], [], []
            for text, found in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                words_n.append(len(words))
                left, last = [], 0
                for begin, end in _cover(found, window):
                    left += words[last:begin]
                    last = end
                left += words[last:]
                removed.append(len(words) - len(left))
                text = b" ".join(left)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", name])

    name = "kept_sha256" if digest else "kept"
    rows = _with_repeats(docs, id_col, text_col, window=window, seed=seed, **options)
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_words bigint, n_removed bigint, {name} string")
