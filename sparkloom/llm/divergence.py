"""Source divergence audit: how far each source's terms are from the other sources of its language.

A language keeps the terms that at least ``least`` of its documents have. They are found by iceberg refinement of byte
prefixes. A term's prefixes of ``first`` bytes, of twice as many, and so on, are counted level by level; a prefix that
fewer than ``least`` distinct documents have is discarded with all terms that begin with it, and the others are extended,
until complete terms remain, whose own documents are counted with their occurrences. Tasks count blocks of whole documents: each row of their output is a term of one language
with its occurrences in each source, and the first row of a prefix carries the number of the block's documents that have
the prefix. A document is in one block only, so a level is a plain sum, exact, combined before its shuffle, and a prefix
that all documents have is one row a block. What survives a level is a table that the next one reads.

Shares are whole numbers (billionths, with one added to each count), so results don't depend on the order of sums. Terms
with the same counts in every source are one row with a weight before pairs of sources are compared, batch by batch; only
sums for pairs are shuffled.

Defined cases: null text, language and source are empty ones; every row is a document, whatever its id; a language
without kept terms has pairs of value 0 and no terms; ties in value are ranked by the item's bytes; other columns are
ignored; an empty table gives none. Terms are runs of letters A-Z (lower-cased) and all characters beyond ASCII, of any
length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage, unstage, utf8

#: Bytes of letters in lower case, and a space for every other ASCII character.
LETTERS = bytes(c if c > 0x7F else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))
#: Bytes of text that are counted together.
BLOCK_BYTES = 12 << 20
TERMS = "lang string, term binary, docs array<bigint>, by array<struct<source: string, n: bigint>>"


def lengths(longest: int, first: int) -> Iterator[int]:
    """Lengths of the proper prefixes by which terms of up to ``longest`` bytes are refined."""
    while first < longest:
        yield first
        first *= 2


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats; numpy's own goes by hashing, which takes longer here."""
    x = np.sort(x)
    return x[np.flatnonzero(np.r_[True, x[1:] != x[:-1]])] if len(x) else x


def counted_block(langs: list[str], sources: list[str], texts: list[bytes | None], first: int) -> pa.RecordBatch | None:
    """Rows of ``TERMS`` for some whole documents: terms and prefixes are numbers here, and counts sizes of equal runs."""
    parts = pc.ascii_split_whitespace(pa.array([(t or b"").translate(LETTERS) for t in texts], pa.large_binary()).cast(pa.large_string()))
    found, doc = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(found), 0)  # splitting leaves empty pieces at the ends
    found, doc = found.filter(real).dictionary_encode(), doc[real.to_numpy(zero_copy_only=False)]
    term, names = found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.large_binary())
    size = len(names)
    if not size:
        return None
    lang_names, lang = np.unique(np.array(langs, object), return_inverse=True)
    group_names, group = np.unique(np.array([f"{a:09d}{s}" for a, s in zip(lang, sources, strict=True)], object), return_inverse=True)
    # occurrences in each source
    keys, n = np.unique(group[doc] * size + term, return_counts=True)
    of_group, of_term = np.divmod(keys, size)
    # a row for each term of a language
    group_lang = np.array([int(g[:9]) for g in group_names], np.int64)
    there = np.zeros(len(lang_names) * size, bool)
    there[group_lang[of_group] * size + of_term] = True
    rows = np.flatnonzero(there)
    row_lang, row_term = np.divmod(rows, size)
    row_of = np.cumsum(there) - 1
    at = row_of[group_lang[of_group] * size + of_term]
    order = np.argsort(at, kind="stable")
    by = pa.StructArray.from_arrays([pa.array([g[9:] for g in group_names], pa.string()).take(pa.array(of_group[order])), pa.array(n[order], pa.int64())], names=["source", "n"])
    by = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(at, minlength=len(rows)))].astype(np.int32)), by)
    # documents of each prefix, on the first row that has it, and of each term
    pairs = _distinct(doc * size + term)
    own_doc, own = np.divmod(pairs, size)
    width = pc.binary_length(names).to_numpy().astype(np.int64)
    levels = list(lengths(int(width.max()), first))
    per_row = np.searchsorted(np.array(levels, np.int64), width[row_term]) + 1
    offset = np.r_[0, np.cumsum(per_row)]
    docs = np.zeros(offset[-1], np.int64)
    docs[offset[1:] - 1] = np.bincount(row_of[lang[own_doc] * size + own], minlength=len(rows))
    for k, length in enumerate(levels):
        heads = pc.binary_slice(names, 0, length).dictionary_encode()
        head, kinds = heads.indices.to_numpy().astype(np.int64), len(heads.dictionary)
        longer = width[own] > length
        own_doc, own = own_doc[longer], own[longer]
        have = _distinct(own_doc * kinds + head[own])
        prefixes, times = np.unique(lang[have // kinds] * kinds + have % kinds, return_counts=True)
        deep = np.flatnonzero(width[row_term] > length)
        same, place = np.unique(row_lang[deep] * kinds + head[row_term[deep]], return_index=True)
        docs[offset[deep[place]] + k] = times[np.searchsorted(prefixes, same)]
    columns = [pa.array(lang_names, pa.string()).take(pa.array(row_lang)), names.take(pa.array(row_term)).cast(pa.binary()), pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(docs)), by]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "docs", "by"])


def counted_terms(docs: DataFrame, first: int = 8) -> DataFrame:
    """(lang, term, docs, by): partial counts; docs[k] are documents with the term's k-th prefix, the last the term itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, bytes | None]] = []
        size = 0
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                held.append(row)
                size += len(row[2] or b"")
                if size > BLOCK_BYTES:
                    yield from made(held)
                    held, size = [], 0
        if held:
            yield from made(held)

    def made(held: list[tuple[str, str, bytes | None]]) -> Iterator[pa.RecordBatch]:
        block = counted_block(*map(list, zip(*held, strict=True)), first)
        for i in range(0, len(block) if block else 0, 20_000):
            yield block.slice(i, 20_000)

    return _named(docs, "text").mapInArrow(run, TERMS)


def _named(docs: DataFrame, *more: str) -> DataFrame:
    return small_batches(docs).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), *(F.col(c).cast("string").alias(c) for c in more))


def kept_terms(docs: DataFrame, least: int = 3, first: int = 8) -> DataFrame:
    """(lang, term, by, n), staged: the kept terms with their occurrences in each source that has them, and in all.

    A term that a level completes has its documents counted along with its occurrences, on the first of its sources, so
    only longer terms are joined with the prefixes that are left.
    """
    levels, out = [stage(counted_terms(docs, first))], None
    while True:
        now, level = levels[-1], len(levels) - 1
        done = now.where(F.size("docs") == level + 1).select("lang", "term", F.element_at("docs", -1).alias("docs"), F.posexplode("by").alias("at", "s"))
        out = done if out is None else out.unionAll(done)
        longer = now.where(F.size("docs") > level + 1)
        if not longer.select("lang").head(1):
            break
        keyed = longer.select("*", F.substring("term", 1, first << level).alias("prefix"))
        frequent = stage(keyed.groupBy("prefix", "lang").agg(F.sum(F.get("docs", F.lit(level))).alias("have")).where(F.col("have") >= least).drop("have"))
        # Spark broadcasts the prefixes where their table is below its own limit, and else joins by sort, prefixes first as they differ most
        levels.append(stage(keyed.join(frequent, ["prefix", "lang"]).select(*now.columns)))
        unstage(frequent)
    counts = out.select("lang", "s.source", "term", "s.n", F.when(F.col("at") == 0, F.col("docs")).otherwise(0).alias("docs"))
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("by"), F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = stage(terms.where(F.col("docs") >= least).drop("docs"))
    for made in levels:
        unstage(made)
    return terms


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)) without rounding and for counts of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * wide(count + 1), wide(total + terms))


def surprise(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so squares fit."""
    return F.call_function("div", (p - q) * (p - q), q)


#: Sums of pairs that a task holds before it passes them on.
HELD_PAIRS = 1 << 20


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of :func:`surprise` for all pairs of a language's sources, from rows (lang, weight, shares)."""
    held: dict[str, np.ndarray] = {}

    def made() -> Iterator[pa.RecordBatch]:
        for lang, sums in held.items():
            a, b = np.divmod(np.flatnonzero(~np.eye(len(sums), dtype=bool)), len(sums))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(sums[a, b], pa.int64())], names=["lang", "a", "b", "value"])

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in set(langs):
            at = np.flatnonzero(langs == lang)
            part = batch.take(pa.array(at))
            p = part.column(2).flatten().to_numpy().reshape(len(at), -1)
            weight = part.column(1).to_numpy()[:, None]
            sums = np.stack([((p - p[:, b : b + 1]) ** 2 // p[:, b : b + 1] * weight).sum(0) for b in range(p.shape[1])], axis=1)
            held[lang] = held[lang] + sums if lang in held else sums
        if sum(x.size for x in held.values()) > HELD_PAIRS:
            yield from made()
            held.clear()
    yield from made()


def divergence(docs: DataFrame, least: int = 3, top: int = 200, first: int = 8) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source its distances to the others, and its most particular terms.

    Part ``pair`` has a row for each other source of the language, part ``term`` the ``top`` terms that are more frequent
    than in the language as a whole.
    """
    groups = _named(docs).distinct()
    terms = kept_terms(docs, least, first)
    of_source = terms.select("lang", F.explode("by").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("total"))
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    figures = stage(groups.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"]))
    langs = figures.groupBy("lang").agg(F.first("terms").alias("terms"), F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # a source's own terms against the language
    own = terms.select("lang", "term", "n", F.inline("by").alias("source", "own")).join(figures, ["lang", "source"])
    p, q = share(F.col("own"), F.col("total"), F.col("terms")), share(F.col("n"), F.col("lang_total"), F.col("terms"))
    own = own.select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    own = own.select("lang", "source", "part", "item", surprise(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    # sources against one another; terms with equal counts everywhere are one profile
    profiles = terms.groupBy("lang", "by").agg(F.count("*").alias("weight")).join(langs, "lang")
    counts = F.map_from_entries("by")
    shares = F.transform("sources", lambda s: share(F.coalesce(F.try_element_at(F.col("counts"), s["source"]), F.lit(0)), s["total"], F.col("terms")))
    profiles = profiles.withColumn("counts", counts).select("lang", "weight", shares.alias("shares"))
    met = profiles.mapInArrow(compared, "lang string, a int, b int, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = langs.select("lang", "sources", F.posexplode("sources").alias("a", "s")).select("lang", "a", "s", F.posexplode("sources").alias("b", "o")).where("a != b")
    pairs = sides.join(met, ["lang", "a", "b"], "left").select("lang", F.col("s.source").alias("source"), F.lit("pair").alias("part"), F.col("o.source").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return own.select(*pairs.columns).unionAll(pairs)


#: The contract of op11 in SQL for DuckDB.
ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
words AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept k USING (lang, term) GROUP BY ALL),
vocabulary AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + v.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN vocabulary v USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
