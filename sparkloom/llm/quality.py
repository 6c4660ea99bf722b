"""Quality classification by ordinal cumulative-link regression.

Documents carry graded ratings 0 < 1 < 2: a point for quality, a point for not being toxic. The model has one weight
vector over hashed text features, shared by all grades, and ordered thresholds: P(grade > k) = sigmoid(w.x - t_k). It
gives the expected grade and the tail probability of the top grade, by which documents are selected.

Features say whether something occurs in the text: words (lower case, without what isn't a letter around them), their
beginnings of three to seven letters, what else is attached to words, four times the same word in a row, and words in
capitals. The whole text is looked at, and its length isn't a feature.

The model is fitted on a sample of labelled rows bounded by ``sample`` (those with the smallest hash of the id); the
fit runs in one executor task over that bounded sample. A text has hundreds of words that few others have, by which a
model would learn its rows by heart, so only features whose occurrence depends on the grade take part: those whose
likelihood ratio statistic of independence, for any threshold between grades, reaches ``bar``. Every row is then scored.

Defined cases: null text is the empty text; labels without a document or with nulls are left out; of several labels of
one id the lowest grade counts; without any labels, or with only one grade, everything has the top grade's tail
probability 1 and is kept; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BITS = 20
WORD = re.compile(r"\S+")
EDGE = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
#: Distinct words that a task remembers before it starts anew.
REMEMBERED = 100_000
BEGINNINGS = (3, 4, 5, 6, 7)


def _hash(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind} {value}".encode()) & ((1 << BITS) - 1)


def _of_word(word: str) -> tuple[int, ...]:
    before, core, after = EDGE.match(word).groups()
    small = core.lower()
    out = [_hash("word", small)] if core else []
    out += [_hash("beginning", small[:k]) for k in BEGINNINGS if len(small) > k]
    out += [_hash("edge", x) for x in (before, after) if x and x not in {".", ",", '"'}]
    if len(core) > 1 and core.isupper():
        out.append(_hash("shape", "capitals"))
    return tuple(out)


def features(text: str | None, memo: dict[str, tuple[int, ...]], used: np.ndarray | None = None) -> np.ndarray:
    """Distinct hashed features of one text, in ascending order; with ``used`` those for which it is true."""
    words = (text or "").split()
    found = {_hash("any", "text")}
    if len(memo) > REMEMBERED:
        memo.clear()
    for w in set(words):
        f = memo.get(w)
        if f is None:
            f = memo[w] = tuple(x for x in _of_word(w) if used is None or used[x])
        found.update(f)
    same = 1
    for a, b in pairwise(words):
        same = same + 1 if a == b else 1
        if same == 4:
            found.add(_hash("shape", "repeated"))
            break
    capitals = sum(w.isupper() for w in words)
    if words and capitals * 2 > len(words):
        found.add(_hash("shape", "mostly capitals"))
    return np.array(sorted(x for x in found if used is None or used[x]), np.int32)


def dependence(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """Likelihood ratio statistic of each feature's independence from ``positive``."""
    index = np.concatenate(rows)
    n, total = len(rows), positive.sum()
    have = np.bincount(index, minlength=1 << BITS).astype(float)
    both = np.bincount(index, weights=np.repeat(positive.astype(float), [len(r) for r in rows]), minlength=1 << BITS)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0)

    cells = ((both, have, total), (have - both, have, n - total), (total - both, n - have, total), (n - total - have + both, n - have, n - total))
    return 2 * sum(part(seen, of * share / n) for seen, of, share in cells)


def screened(rows: list[np.ndarray], grades: np.ndarray, bar: float) -> np.ndarray:
    """Which features the grade depends on; the one that all texts have takes part always."""
    out = np.zeros(1 << BITS, bool)
    for k in range(int(grades.max())):
        out |= dependence(rows, grades > k) >= bar
    out[_hash("any", "text")] = True
    return out


def log_likelihood(score: np.ndarray, grades: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log likelihood of the grades, and its slope by score minus threshold, for each row and threshold."""
    top, each = len(thresholds), np.arange(len(score))
    wide = np.clip(score[:, None] - thresholds, -30, 30)
    tail = 1 / (1 + np.exp(-wide))  # P(grade > k)
    full = np.c_[np.ones(len(score)), tail, np.zeros(len(score))]
    slope = np.c_[np.zeros(len(score)), tail * (1 - tail), np.zeros(len(score))]
    chance = (full[each, grades] - full[each, grades + 1]).clip(1e-9)
    d = np.zeros_like(wide)
    low, high = grades > 0, grades < top
    d[each[low], grades[low] - 1] += slope[each[low], grades[low]] / chance[low]
    d[each[high], grades[high]] -= slope[each[high], grades[high] + 1] / chance[high]
    # rows weigh the same, so a text that shows nothing gets the grades' own shares
    return float(np.log(chance).mean()), d / len(grades)


def fit(rows: list[np.ndarray], grades: np.ndarray, l2: float = 1e-3, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds for the grades from 1 on) by full-batch Adam on the cumulative-link likelihood."""
    classes = np.unique(grades)
    top = int(classes.max())
    index = np.concatenate(rows)
    starts = np.cumsum([0, *(len(r) for r in rows[:-1])])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weights, base = np.zeros(1 << BITS), np.array([-2.0])
    gaps = np.zeros(max(0, top - 1))  # logarithms of the thresholds' distances
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, base, gaps)]

    for step in range(1, steps + 1):
        thresholds = base[0] + np.r_[0, np.cumsum(np.exp(gaps))]
        score = np.add.reduceat(weights[index], starts)
        _, d = log_likelihood(score, grades, thresholds)
        by_threshold = -d.sum(0)
        grads = (
            -(np.bincount(index, weights=d.sum(1)[owner], minlength=len(weights)) - l2 * weights),
            -np.array([by_threshold.sum()]),
            -np.array([by_threshold[k + 1 :].sum() * np.exp(gaps[k]) for k in range(len(gaps))]),
        )
        for x, g, (m, v) in zip((weights, base, gaps), grads, state, strict=True):
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights, base[0] + np.r_[0, np.cumsum(np.exp(gaps))]


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 8_000, bar: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(places, weights, thresholds) as bytes, with the weights of features that take part; no row where there is nothing to tell apart; only the sample's features reach the one task."""
    rated = labels.select(F.col("doc_id").alias("id"), (F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")).alias("grade"))
    rated = rated.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    # at most `sample` ids, so they can be broadcast
    chosen = F.broadcast(rated.orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("grade", "text", F.xxhash64("id").alias("h"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features(t, memo).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["grade", "h", "found"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((h, g, x) for b in batches for g, h, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        grades = np.array([g for _, g, _ in held], int)
        if len(np.unique(grades)) > 1:
            rows = [np.frombuffer(x, np.int32) for *_, x in held]
            used = screened(rows, grades, bar)
            weights, thresholds = fit([x[used[x]] for x in rows], grades)
            at, values = _sparse(weights)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (at, values, thresholds)], names=["places", "weights", "thresholds"])

    return rows.mapInArrow(shrink, "grade int, h bigint, found binary").repartition(1).mapInArrow(learn, "places binary, weights binary, thresholds binary")


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, bar: float = 20.0, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray] | None:
    """The fitted model, or None where there is nothing to tell apart."""
    found = fitted(docs, labels, sample, bar, id_col, text_col).first()
    if not found:
        return None
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(found[0], np.int64)] = np.frombuffer(found[1])
    return weights, np.frombuffer(found[2])


def _sparse(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a task needs of the weights: few features take part."""
    at = np.flatnonzero(weights)
    return at, weights[at]


def _dense(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, which of them are used)"""
    weights, used = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
    weights[at], used[at] = values, True
    return weights, used


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_grade, p_top, keep) for every row; keep if the top grade's tail probability reaches ``threshold``."""
    weights, thresholds = model or (np.zeros(1 << BITS, np.float32), np.array([-np.inf, -np.inf]))
    held = _sparse(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        of, used = _dense(*held)
        for batch in batches:
            scores = np.array([of[features(t, memo, used)].sum() for t in batch.column(1).to_pylist()])
            tails = 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds, -500, 500)))
            p = tails[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(1)), pa.array(p), pa.array(p >= threshold)], names=["id", "expected_grade", "p_top", "keep"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, expected_grade double, p_top double, keep boolean")


def select(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    weights, thresholds = model or (np.zeros(1 << BITS, np.float32), np.array([-np.inf]))
    at, bar = docs.columns.index(text_col), thresholds[-1] + np.log(threshold / (1 - threshold))
    held = _sparse(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        of, used = _dense(*held)
        for batch in batches:
            yield batch.filter(pa.array([bool(of[features(t, memo, used)].sum() >= bar) for t in batch.column(at).to_pylist()], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
