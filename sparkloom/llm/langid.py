"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram is bound by multiplying its
letters' vectors, each rotated by its place; a text bundles (adds) the vectors of all its n-grams, where runs of
anything but letters count as one space, and a language's prototype bundles the training texts. The prediction is the
language with the largest cosine, which is also the score (at least 0). A text's n-grams are counted first, so each
distinct one of a slice of texts is bound once, in blocks of bounded size however many there are; letters are taken in
parts of bounded size, so a text's length doesn't matter either.

Training adds up prototypes where the texts are; only the sums, one vector for each language, reach the driver.

Defined cases: null text and text without letters are ``und`` with score 0, and so is everything where nothing was
learned; rows without an id or language aren't learned from; of equal cosines the first language by name wins; repeated
rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

#: Texts longer than this many characters are counted in parts.
PART = 1 << 18
#: Cells of the matrix of counts, and n-grams, that are held at a time.
CELLS, GRAMS = 1 << 21, 1 << 13


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(4096)
def _vector(point: int, size: int) -> np.ndarray:
    return np.random.default_rng([7, point]).integers(0, 2, size, np.int8).astype(np.float32) * 2 - 1


def _points(text: str) -> np.ndarray:
    """Lower-case letters as code points; 0 for each run of others, at both ends too."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    points = np.where(_letters()[points], points, 0)
    return points[(points != 0) | np.r_[True, points[:-1] != 0]] if len(points) else points


def _numbered(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order and each value's place among them."""
    if bound > 1 << 22:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(bound, bool)
    seen[values] = True
    distinct = np.flatnonzero(seen)
    place = np.zeros(bound, np.int32)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[values]


def _streams(texts: list[str], n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, its letters): long texts in parts that overlap by n - 1 letters."""
    for i, text in enumerate(texts):
        tail = np.zeros(1, np.uint32)
        for a in range(0, len(text), PART):
            points = _points(text[a : a + PART])
            if len(points) and points[0] == 0 and tail[-1] == 0:
                points = points[1:]
            points = np.r_[tail, points]
            if a + PART >= len(text) and points[-1] != 0:
                points = np.r_[points, np.uint32(0)]
            yield i, points
            tail = points[-(n - 1) :] if n > 1 else points[:0]


def _counts(streams: list[tuple[int, np.ndarray]], texts: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of distinct n-grams, a row of n code points each, with a matrix of their counts in each text."""
    flat = np.concatenate([s for _, s in streams]) if streams else np.zeros(0, np.uint32)
    size = len(flat) - n + 1
    if size <= 0:
        return
    owner = np.repeat(np.arange(len(streams), dtype=np.int32), [len(s) for _, s in streams])
    alphabet, code = _numbered(flat, 0x110000)
    width = len(alphabet)
    key = np.zeros(size, np.int64)
    for j in range(n):
        key = key * width + code[j : j + size]
    whole = owner[:size] == owner[n - 1 :]
    key, text = key[whole], np.array([i for i, _ in streams], np.int32)[owner[:size][whole]]
    distinct, gram = _numbered(key, width**n)
    block = max(1, min(GRAMS, CELLS // max(1, texts)))
    if len(distinct) > block:
        order = np.argsort(gram, kind="stable")
        gram, text = gram[order], text[order]
    cuts = np.searchsorted(gram, np.arange(0, len(distinct) + block, block)) if len(distinct) > block else [0, len(gram)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        own = distinct[k * block : (k + 1) * block]
        counts = np.bincount(text[a:b].astype(np.int64) * len(own) + (gram[a:b] - k * block), minlength=texts * len(own)).reshape(texts, -1)
        yield np.stack([alphabet[own // width ** (n - 1 - j) % width] for j in range(n)], 1), counts.astype(np.float32)


def bind(points: np.ndarray, size: int) -> np.ndarray:
    """One vector for each row of letters."""
    out = np.ones((len(points), size), np.float32)
    n = points.shape[1]
    for j in range(n):
        distinct, at = np.unique(points[:, j], return_inverse=True)
        turned = np.stack([np.roll(_vector(int(p), size), n - 1 - j) for p in distinct]) if len(distinct) else np.zeros((0, size), np.float32)
        out *= turned[at]
    return out


def bundle(texts: list[str | None], n: int, size: int) -> np.ndarray:
    """One vector for each text; zeros where there is no letter."""
    some = [x if x and any(map(str.isalpha, x)) else "" for x in texts]
    out = np.zeros((len(texts), size), np.float32)

    def add(held: list[tuple[int, np.ndarray]]) -> None:
        # the texts of a part that doesn't fit the rest are few
        at = sorted({i for i, _ in held})
        place = {i: k for k, i in enumerate(at)}
        for points, counts in _counts([(place[i], s) for i, s in held], len(at), n):
            out[at] += counts @ bind(points, size)

    held: list[tuple[int, np.ndarray]] = []
    for i, stream in _streams(some, n):
        if held and sum(len(s) for _, s in held) + len(stream) > 4 * PART:
            add(held)
            held = []
        held.append((i, stream))
    if held:
        add(held)
    return out


def train(docs: DataFrame, n: int = 3, size: int = 512, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language."""
    rows = small_batches(docs).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices([max(1024, len(x)) for x in texts], 2 << 20):
                vectors = bundle(texts[a:b], n, size)
                own = np.array(langs[a:b], object)
                for lang in set(langs[a:b]):
                    sums[lang] = sums.get(lang, 0) + vectors[own == lang].sum(0, dtype=np.float64)
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["lang", "vector"])

    parts = rows.mapInArrow(run, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("i", "x"))
    found = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", F.col("v.x").alias("v")).collect()
    return {r["lang"]: np.array(r["v"]) for r in sorted(found, key=lambda r: r["lang"]) if np.any(r["v"])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], n: int = 3, size: int = 512, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of ``keep``, lang_pred and score for every row."""
    names = sorted(prototypes)
    table = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names], np.float32).reshape(-1, size)
    rows = small_batches(docs).select(*keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            langs, scores = [], []
            for a, b in slices([max(1024, len(x or "")) for x in texts], 2 << 20):
                vectors = bundle(texts[a:b], n, size)
                length = np.linalg.norm(vectors, axis=1)
                if not names:
                    langs += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                cosine = vectors @ table.T / np.where(length > 0, length, 1)[:, None]
                best = cosine.argmax(1)
                langs += [names[k] if x > 0 else "und" for k, x in zip(best.tolist(), length.tolist(), strict=True)]
                scores += np.where(length > 0, cosine[np.arange(b - a), best].clip(0, 1), 0).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; never for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train_and_predict(docs: DataFrame, n: int = 3, size: int = 512) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); held-out rows are never learned from."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return predict(rows, train(rows.where("not held_out and doc_id is not null"), n, size), n, size, ("doc_id", "held_out"))
