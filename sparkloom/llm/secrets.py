"""Secret scanning with a random forest that removes false positives.

The scanner's rules report findings generously: known key formats, quoted values assigned to a name, long runs with
digits, and very long words. Each finding is described by its length, its character transitions (mean log probability
under the transitions within all words of the corpus), its dictionary coverage (share of it in words of four to twelve
letters that make up at least ``rate`` of the corpus' words), its path (the document's source) and its neighbouring
words. A random forest is trained on labelled findings, and a finding counts as a secret if the forest gives it half
the votes.

Labels come from ``labelled`` (doc_id, start, secret), or where none are given from rules that are sure of themselves:
known formats and mixed values under a secret's name are secrets; pure numbers, repeated characters, placeholders,
values made up of words, and very long words that reach ``rate`` themselves aren't; all else is unlabelled and left to
the forest. Findings of held-out documents (crc32 of the id as text leaves 2 when divided by 4) are never
trained on, so the forest can be measured against their labels. Of the rest about ``sample`` are trained on, an equal
share for each label, chosen by a hash. Word counts are of all words of all documents; at most 1 / ``rate`` words can
reach the dictionary's rate, and transitions are between 29 classes of characters, so both are of bounded size.

Defined cases: null text has no findings; a null source is an empty path; where the labels to train on don't hold both
classes every finding keeps probability 1 if it isn't labelled false; repeated rows each have their findings; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

# The scanner's rules, each with what it is called.
FORMATS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")
ASSIGNED = re.compile(r"(?i)\b([a-z_-]{2,40})[ \t]{0,3}[=:][ \t]{0,3}[\"']([^\"'\s]{8,})[\"']")
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{16,}(?![A-Za-z0-9+/_=-])")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}")
NAMES = re.compile(r"(?i)(token|secret|passw|pwd|api[_-]?key|auth|credential|private[_-]?key|access[_-]?key)")
PLACEHOLDER = re.compile(r"(?i)example|change_?me|your|placeholder|dummy|xxxx|\*\*\*|<|\$\{")
TEST_PATH = re.compile(r"(?i)test|example|sample|doc|fixture")
BUCKETS = 12
FEATURES = 9 + 2 + 3 * BUCKETS


def _class(c: str) -> str:
    return c if "a" <= c <= "z" else "0" if c.isdigit() else "A" if c.isupper() else "*"


def findings(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, rule, name that the value is assigned to); findings don't overlap, the first rule that reports wins."""
    out: list[tuple[int, int, str, str]] = []
    for rule, pattern, group in (("format", FORMATS, 0), ("assigned", ASSIGNED, 2), ("run", RUN, 0), ("word", WORD, 0)):
        if rule == "assigned" and not ("=" in text or ":" in text):
            continue
        taken = sorted(out)
        k = 0
        for m in pattern.finditer(text):
            a, b = m.span(group)
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if k == len(taken) or taken[k][0] >= b:
                out.append((a, b, rule, m[1] if rule == "assigned" else ""))
    return sorted(out)


def rule_label(value: str, rule: str, name: str) -> float | None:
    """1 or 0 where the rules are sure, else None."""
    if PLACEHOLDER.search(value) or len(set(value)) <= 3 or value.isdigit():
        return 0.0
    if rule == "format":
        return 1.0
    if rule == "word":
        return None
    if re.fullmatch("[A-Za-z]+(?:[-_][A-Za-z]+)*[0-9]?", value):
        return 0.0
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return 1.0 if mixed and NAMES.search(name) and len(value) >= 16 else None


KINDS = [*"abcdefghijklmnopqrstuvwxyz", "0", "A", "*"]


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all words of two letters or more in all texts, in lower case."""
    word = F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+")).alias("word")
    return docs.select(word).where("length(word) >= 2").groupBy("word").agg(F.count("*").alias("n"))


def transitions(counts: DataFrame) -> dict[str, float]:
    """Log probability of each class of characters after each other, over all words as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = "".join(map(_class, word))
                for a, b in pairwise(low):
                    seen[a + b] = seen.get(a + b, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pair", "n"])

    summed = {r["pair"]: r["n"] for r in counts.select("word", "n").mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    total = {a: sum(summed.get(a + b, 0) for b in KINDS) for a in KINDS}
    return {a + b: math.log((summed.get(a + b, 0) + 1) / (total[a] + len(KINDS))) for a in KINDS for b in KINDS}


def dictionary(counts: DataFrame, rate: float) -> frozenset[str]:
    """Words of four to twelve letters that are at least ``rate`` of all words; there can't be more than 1 / rate."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r["word"] for r in counts.where((F.col("n") >= rate * total) & F.length("word").between(4, 12)).select("word").collect())


def describe(text: str, begin: int, end: int, path: str, moves: dict[str, float], known: frozenset[str]) -> list[float]:
    value = text[begin:end]
    low = [_class(c) for c in value]
    steps = [moves[a + b] for a, b in zip(low, low[1:], strict=False)]
    lower, covered, i = value.lower(), 0, 0
    while i < len(lower):
        n = next((n for n in range(min(12, len(lower) - i), 3, -1) if lower[i : i + n] in known), 0)
        covered += n
        i += n or 1
    n = len(value)
    share = [sum(map(f, value)) / n for f in (str.isdigit, str.islower, str.isupper)]
    entropy = -sum(k / n * math.log2(k / n) for k in (value.count(c) for c in set(value)))
    out = [float(n), math.log(n), sum(steps) / max(1, len(steps)), covered / n, entropy, *share, float(bool(re.fullmatch("[0-9a-fA-F]+", value)))]
    out += [float(path.count("/")), float(bool(TEST_PATH.search(path)))]
    before = re.findall(r"\w+", text[max(0, begin - 48) : begin])[-2:]
    after = re.findall(r"\w+", text[end : end + 32])[:1]
    words = [0.0] * (3 * BUCKETS)
    for place, w in ((0, before[-1:]), (1, before[:-1]), (2, after)):
        for x in w:
            words[place * BUCKETS + zlib.crc32(x.lower().encode()) % BUCKETS] = 1.0
    return out + words


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def scan(docs: DataFrame, labelled: DataFrame | None = None, sample: int = 20_000, rate: float = 1e-5, trees: int = 30, depth: int = 6, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, start, end, rule, name, p_secret, secret, label, held_out): one row for each finding."""
    counts = stage(word_counts(docs, text_col))
    moves, known = transitions(counts), dictionary(counts, rate)
    schema = pa.schema([("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string()), ("name", pa.string()), ("label", pa.float64()), ("word", pa.string()), ("described", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (text, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for a, b, rule, name in findings(text or ""):
                    at.append(k)
                    rows.append((a, b, rule, name, rule_label(text[a:b], rule, name), text[a:b].lower() if rule == "word" else None, describe(text, a, b, path or "", moves, known)))
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", *schema.names])

    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))
    found = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, start bigint, end bigint, rule string, name string, label double, word string, described array<double>")
    found = stage(found.withColumn("held_out", held_out("doc_id")))
    if labelled is not None:
        marks = labelled.select(F.col("doc_id"), F.col("start").cast("bigint").alias("start"), F.col("secret").cast("double").alias("label")).dropDuplicates(["doc_id", "start"])
        found = stage(found.drop("label").join(marks, ["doc_id", "start"], "left"))
    else:
        total = counts.agg(F.sum("n")).first()[0] or 0
        often = counts.where((F.col("n") >= rate * total) & (F.length("word") >= 16)).select("word", F.lit(0.0).alias("is_common"))
        found = stage(found.join(often, "word", "left").withColumn("label", F.coalesce("label", "is_common")))
    sure = found.where("label is not null and not held_out")
    size = {r["label"]: r["count"] for r in sure.groupBy("label").count().collect()}
    shown = ["doc_id", "start", "end", "rule", "name", "p_secret", "secret", "label", "held_out"]
    if len(size) < 2:
        return found.withColumn("p_secret", F.coalesce("label", F.lit(1.0))).withColumn("secret", F.col("p_secret") >= 0.5).select(shown)
    share = F.coalesce(*(F.when(F.col("label") == k, F.lit(min(1.0, sample / len(size) / n))) for k, n in size.items()))
    taken = sure.where(F.xxhash64("doc_id", "start").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53) < share)
    taken = stage(taken.select("label", "described")).select("label", array_to_vector("described").alias("features"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(taken)
    scored = model.transform(found.withColumn("features", array_to_vector("described")))
    return scored.withColumn("p_secret", F.round(vector_to_array("probability")[1], 9)).withColumn("secret", F.col("p_secret") >= 0.5).select(shown)
