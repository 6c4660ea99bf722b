"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes marks boundaries: at level k where its low k bits are all ones, so boundaries
of a coarser level are boundaries of all finer ones, about 2^k bytes apart. A fingerprint is the finest level with less
than 64 chunks, the signature there (one of 64 letters a chunk, from a hash of the chunk) and the signature one level
coarser: ``level:signature:signature``. Two fingerprints are compared by edit distance where they have a level in
common, and are 0 alike where they have none. All of a text counts, and only its bytes do.

Defined cases: null text is taken as empty; the empty text's fingerprint is ``0::``, and two empty texts are 1 alike.
Rows without an id come before all others; rows of one id are in order of their text's hash; the only row of a table
follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, utf8
from .substrings import BASE, LETTER, _mix, _power

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SPAN = 7
LEVELS = 40
#: Equal rows that are made of one row at a time.
REPEATS = 10_000
BLOCK = 1 << 20


def _marks(data: np.ndarray) -> np.ndarray:
    """For each byte, the number of low one bits of the rolling hash that ends there."""
    out = np.empty(len(data), np.uint8)
    for a in range(0, len(data), BLOCK):
        value = LETTER[data[max(0, a - SPAN + 1) : a + BLOCK]]
        size, skip = len(value), min(a, SPAN - 1)
        rolled = np.zeros(size, np.uint64)
        for j in range(min(SPAN, size)):
            rolled[j:] += value[: size - j] * np.uint64(2 * j + 1 << 7 | 1)
        rolled = _mix(rolled)[skip:]
        low = ~rolled & (rolled + np.uint64(1))  # the lowest zero bit; none is left of 64 ones
        level = np.bitwise_count(low - np.uint64(1))
        out[a : a + BLOCK] = level
    return out


def _letters(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A letter for each chunk, from a hash that doesn't depend on where it stands."""
    power, inverse = _power(BLOCK)
    total = np.zeros(len(begin), np.uint64)
    for a in range(0, len(data), BLOCK):
        part = LETTER[data[a : a + BLOCK]]
        summed = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=summed[1:])
        here = summed[(end - a).clip(0, len(part))] - summed[(begin - a).clip(0, len(part))]
        total += here * np.uint64(pow(BASE, a, 1 << 64))
    back = inverse[begin] if begin.max() < BLOCK else np.array([pow(BASE, -int(b), 1 << 64) for b in begin], np.uint64)
    return ALPHABET[(_mix(total * back) >> np.uint64(58)).astype(np.int64)]


def fingerprint(text: bytes | None) -> str:
    if not text:
        return "0::"
    data = np.frombuffer(text, np.uint8)
    marks = _marks(data)
    places = np.flatnonzero(marks >= min(LEVELS, max(0, len(data).bit_length() - 8)))  # far more than 64 below that level
    if len(places) < 63:
        places = np.flatnonzero(marks)
    level = marks[places]
    count = np.bincount(level, minlength=LEVELS + 2)[::-1].cumsum()[::-1]
    k = next(k for k in range(1, LEVELS + 1) if count[k] < 63 or k == LEVELS)
    begin, end, cut = [], [], 0
    for at in (level >= k, level >= k + 1):
        ends = places[at] + 1
        ends = ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))
        begin += [[0], ends[:-1]]
        end.append(ends)
        cut = cut or len(ends)
    letters = _letters(data, np.concatenate(begin), np.concatenate(end)).tobytes().decode()
    return f"{k}:{letters[:cut]}:{letters[cut:]}"


def likeness(a: str, b: str) -> Column:
    """0 to 1 for two fingerprint columns."""
    level = [F.split(F.col(x), ":")[0].cast("int") for x in (a, b)]
    part = lambda x, i: F.split(F.col(x), ":")[i]

    def alike(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / longest)

    return (
        F.when(F.col(a) == F.col(b), F.lit(1.0))
        .when(level[0] == level[1], F.greatest(alike(part(a, 1), part(b, 1)), alike(part(a, 2), part(b, 2))))
        .when(level[0] == level[1] + 1, alike(part(a, 1), part(b, 2)))
        .when(level[0] + 1 == level[1], alike(part(a, 2), part(b, 1)))
        .otherwise(F.lit(0.0))
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x) for x in utf8(batch.column(1))], pa.string())], names=["id", "fingerprint"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fingerprint string")


def with_next(docs: DataFrame, group_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, times, follows): each partition is a range of rows in order, ended by the next range's first row with
    ``follows`` set, so each row's successor stands right behind it. The last row is followed by the first one.

    Rows are in order of id (none comes first), then of their text's hash. Spark cuts ranges over these keys alone, without
    the texts, so many rows of one id or without any spread over ranges. Equal rows that fill whole ranges are one row
    with their number in ``times``, which is 1 otherwise. The driver keeps a key for each ``group_bytes`` of text or so.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(partitions(spark) * 2, -(-total // group_bytes))
    keys = rows.select(F.col("id").isNotNull().alias("known"), "id", "hash")
    ranges = keys.repartitionByRange(groups, "known", "id", "hash", F.rand(0)).groupBy(F.spark_partition_id().alias("part"))
    begins = Counter((r["k"]["known"], r["k"]["id"] or 0, r["k"]["hash"]) for r in ranges.agg(F.min(F.struct("known", "id", "hash")).alias("k")).collect())
    firsts = sorted(begins)
    without = np.array([h for known, _, h in firsts if not known], np.int64)
    cut_ids = np.array([i for known, i, _ in firsts if known], np.int64)
    cut_hashes = np.array([h for known, _, h in firsts if known], np.int64)

    @F.pandas_udf("int")
    def group(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        known, h = ids.notna().to_numpy(), hashes.to_numpy(np.int64)
        i = ids.fillna(0).to_numpy(np.int64)
        out = np.searchsorted(without, h, side="right")  # ranges that begin at or before the key
        below, upto = (np.searchsorted(cut_ids, i, side=x) for x in ("left", "right"))
        out[known] = len(without) + below[known]
        among = known & (below < upto)
        for b in np.unique(below[among]):
            at = among & (below == b)
            same = cut_hashes[b : np.searchsorted(cut_ids, cut_ids[b], side="right")]
            out[at] += np.searchsorted(same, h[at], side="right")
        return pd.Series((out - 1).clip(0).astype("int32"))

    # a range's first row also ends the range before it; the first of all ends the last one
    marks = spark.createDataFrame([((g - 1) % len(firsts), i if known else None, h, begins[known, i, h] > 1) for g, (known, i, h) in enumerate(firsts)], "grp int, i bigint, h bigint, many boolean")
    key = F.expr("id <=> i and hash = h")
    same = rows.join(F.broadcast(marks), key).groupBy("grp", "id", "hash", "many", "text").agg(F.count("*").alias("times"))
    ends = same.groupBy("grp", "id", "hash").agg(F.min("text").alias("text")).select("grp", "id", "hash", "text", F.lit(1).alias("times"), F.lit(1).alias("follows"))
    single = rows.join(F.broadcast(marks.where("many")), key, "left_anti").withColumn("times", F.lit(1))
    own = single.unionByName(same.where("many").select("id", "text", "hash", "times"))
    own = own.select(group("id", "hash").alias("grp"), "id", "hash", "text", "times", F.lit(0).alias("follows"))
    ordered = own.unionAll(ends).repartitionById(max(len(firsts), 1), F.col("grp")).sortWithinPartitions("follows", "id", "hash", "text")
    return ordered.select("id", "text", "times", "follows")


def compare_with_edited(docs: DataFrame, group_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, that of its text with the last quarter replaced by the next row's beginning, and likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "times"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64()]

    def row(i: int | None, text: str, own: str, after: str, after_own: str, times: int) -> tuple:
        cut = len(text) // 4
        edited = (text[: len(text) - cut] + after[:cut]).encode()
        return i, len(text), hashlib.sha256(edited).hexdigest(), own, fingerprint(edited), after_own, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row before, without its successor as yet
        for batch in batches:
            out = []
            for i, text, times, follows in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                own = fingerprint(text.encode())
                if held is not None:
                    out.append(row(*held, text, own, 1))
                if times > 1:  # all but the last of equal rows are followed by their like
                    like = row(i, text, own, text, own, 1)
                    out += [(*like[:-1], min(REPEATS, times - 1 - k)) for k in range(0, times - 1, REPEATS)]
                held = None if follows else (i, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, times bigint"
    found = with_next(small_batches(docs), id_col=id_col, text_col=text_col, group_bytes=group_bytes).mapInArrow(run, schema)
    found = found.withColumns({"near_edited": likeness("fingerprint", "edited_fingerprint"), "near_next": likeness("fingerprint", "next_fingerprint")})
    return found.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("next_fingerprint", "times")
