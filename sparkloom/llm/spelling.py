"""Spelling variant grouping by a dictionary of trie-node pairs.

Words are the nodes' paths of two tries, one over the words and one over the reversed words. A word with one position
skipped is the pair (node of what is before it, node of what is behind it); so is the place between two positions where
one may be inserted. Two words that differ in one replaced letter meet in a pair that both skip; two that differ in one
inserted letter meet where the longer one skips and the shorter one has a place. Nodes are numbered, so the join is one of
integers, exact, with nothing to be verified, and without comparing words.

Numbering is a walk over sorted words: a node gets its number where the first word reaches it. Nodes of fewer than
``HEAD`` letters, which all words share, have their letters as number; deeper ones are met by words of one head only, so
words are partitioned by their first ``HEAD`` letters and each task numbers its nodes as its sorted rows stream by, with
memory for one word. A pair that is skipped by many words has as many at most as there are letters, and a place belongs
to one word, so no group of the join grows with the corpus. Of equal neighbouring letters only the first is skipped where
a letter was deleted, so each pair of near words meets once and near words are counted without making pairs of words.

Words are numbered by falling frequency and rising bytes, so the nearest form is a minimum. Forms are followed to roots
by doubling: a form is ``ratio`` times as frequent, so chains are short.

Defined cases: null and empty texts have no words; a null id is an empty one in the checksum; every row is counted, equal
ones too; ties in frequency go to the smallest word; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, unstage, utf8

RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Letters in the number of a shallow node (7 bits each), and words' partitions.
HEAD = 8
#: Distinct words that a task holds before it passes them on.
HELD_WORDS = 300_000
#: Rows of an Arrow batch of pairs.
PAIR_ROWS = 100_000


def damaged(run: bytes, checksum: int, every: int = 31) -> bytes:
    """A run without one of its letters if ``every`` divides the checksum."""
    if checksum % every:
        return run
    letters = run.decode()
    at = checksum % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def words(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of ``shortest`` letters or more that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                start = zlib.crc32(f"{i}:".encode())
                for w, n in Counter(RUN.findall((text or b"").lower())).items():
                    if len(w) >= shortest:  # bytes are no fewer than letters
                        w = damaged(w, zlib.crc32(w, start), every)
                        if len(w) >= shortest and (w.isascii() or len(w.decode()) >= shortest):
                            held[w] += n
                if len(held) > HELD_WORDS:
                    yield from counted(held)
                    held.clear()
        yield from counted(held)

    def counted(held: Counter) -> Iterator[pa.RecordBatch]:
        names = list(held)
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in part], pa.string()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])

    rows = small_batches(docs).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _codes(word: str) -> list[int]:
    """Letters as numbers from 1 to 90: a to z, then U+00C0 to U+00FF."""
    return [c - 96 if c < 128 else c - 165 for c in map(ord, word)]


def _head_numbers(codes: list[int]) -> list[int]:
    """Numbers of the nodes of up to HEAD - 1 letters: their letters, negative, so that they differ from counted ones."""
    out, number = [], 1
    for c in (0, *codes[: HEAD - 1]):
        number = number * 128 + c if c else number
        out.append(-number)
    return out


class _Walk:
    """Numbers the nodes on each word's path; words come sorted, all words of one head to one task."""

    def __init__(self, partition: int) -> None:
        self.next, self.before, self.path = partition << 40, "", [0]

    def __call__(self, word: str) -> list[int]:
        same, end = 0, min(len(word), len(self.before))
        while same < end and word[same] == self.before[same]:
            same += 1
        path = self.path[: same + 1]
        if same < HEAD - 1:
            path = _head_numbers(_codes(word[: HEAD - 1]))
        fresh = len(word) + 1 - len(path)
        path += range(self.next, self.next + fresh)
        self.next += fresh
        self.before, self.path = word, path
        return path


def _walked(rows: DataFrame, of: str, use: Callable[[pa.RecordBatch, _Walk], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows sorted by their column ``of`` within the heads' partitions, mapped by ``use`` with the task's walk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(TaskContext.get().partitionId())
        for batch in batches:
            yield from use(batch, walk)

    return rows.repartition(F.substring(of, 1, HEAD)).sortWithinPartitions(of).mapInArrow(run, schema)


def node_pairs(ranked: DataFrame) -> DataFrame:
    """(front, back, id, kind) from (id, word): kind 0 skips a letter, 1 one that equals the letter before it, 2 is a place."""

    def forward(batch: pa.RecordBatch, walk: _Walk) -> Iterator[pa.RecordBatch]:
        nodes = [walk(w) for w in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.list_(pa.int64()))], names=["id", "reversed", "front"])

    def pairs(batch: pa.RecordBatch, walk: _Walk) -> Iterator[pa.RecordBatch]:
        fronts, backs, ids, kinds, held = [], [], [], [], 0
        for i, back_word, front in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            back = walk(back_word)[::-1]  # back[k] is the node of what is behind the first k letters
            n = len(back_word)
            word = back_word[::-1]
            # skipped letters, then places: none at the ends is left out
            fronts.append(np.array([*front[:-1], *front], np.int64))
            backs.append(np.array([*back[1:], *back], np.int64))
            kinds.append(np.array([*(int(k > 0 and word[k] == word[k - 1]) for k in range(n)), *[2] * (n + 1)], np.int8))
            ids.append(np.full(2 * n + 1, i, np.int64))
            held += 2 * n + 1
            if held > PAIR_ROWS:
                yield packed(fronts, backs, ids, kinds)
                fronts, backs, ids, kinds, held = [], [], [], [], 0
        if ids:
            yield packed(fronts, backs, ids, kinds)

    def packed(*columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["front", "back", "id", "kind"])

    named = ranked.select("id", "word", F.reverse("word").alias("reversed"))
    numbered = _walked(named, "word", forward, "id bigint, reversed string, front array<bigint>")
    return _walked(numbered.select("id", "reversed", "front"), "reversed", lambda b, w: pairs(b, w), "front bigint, back bigint, id bigint, kind tinyint")


def near_words(ranked: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words that have near words; best is the smallest of their ids."""
    skips = F.filter("met", lambda m: m["kind"] < 2)
    leads = F.filter("met", lambda m: m["kind"] == 0)
    places = F.filter("met", lambda m: m["kind"] == 2)
    groups = node_pairs(ranked).groupBy("front", "back").agg(F.collect_list(F.struct("id", "kind")).alias("met")).where(F.size("met") > 1)
    groups = groups.withColumns({"skips": F.array_sort(F.transform(skips, lambda m: m["id"])), "leads": F.array_sort(F.transform(leads, lambda m: m["id"])), "places": F.transform(places, lambda m: m["id"])})
    each = groups.select("skips", "leads", "places", F.inline("met"))
    # words that skip here are near one another; a first of equal letters is near the word of the place, and that near all such
    other = F.when(F.get("skips", F.lit(0)) == F.col("id"), F.get("skips", F.lit(1))).otherwise(F.get("skips", F.lit(0)))
    count = F.when(F.col("kind") == 2, F.size("leads")).otherwise(F.size("skips") - 1 + F.when(F.col("kind") == 0, F.size("places")).otherwise(0))
    best = F.when(F.col("kind") == 2, F.get("leads", F.lit(0))).otherwise(F.least(other, F.when(F.col("kind") == 0, F.get("places", F.lit(0)))))
    return each.select("id", count.cast("bigint").alias("n"), best.alias("best")).where("n > 0").groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31, ratio: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with the frequent spelling that it varies, if any, and the group's root."""
    found = words(docs, shortest, least, every, id_col, text_col)
    # ids follow frequency, then bytes
    ranked = stage(found.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = stage(near_words(ranked))
    named = ranked.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    linked = ranked.join(near, "id", "left").join(named, "best", "left")
    taken = F.col("form_n") >= ratio * F.col("n")
    linked = stage(linked.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), *(F.when(taken, F.col(c)).alias(c) for c in ("best", "form", "form_n"))))
    unstage(near)
    roots = _roots(linked.where("best is not null").select("id", F.col("best").alias("up")))
    last = roots.join(ranked.select(F.col("id").alias("up"), F.col("word").alias("root")), "up").select("id", "root")
    return linked.join(last, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Links (id, up) followed to their ends, twice as far each round."""
    now = stage(links)
    while True:
        further = now.select(F.col("id").alias("up"), F.col("up").alias("above"))
        if not now.join(further, "up", "left_semi").head(1):
            return now
        made = stage(now.join(further, "up", "left").select("id", F.coalesce("above", "up").alias("up")))
        unstage(now)
        now = made
