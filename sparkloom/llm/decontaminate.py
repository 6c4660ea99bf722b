"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table of postings (term, doc_id, copy, pos) of the training texts, for the terms that test items
use: no other posting can be part of an answer. Items are cut into windows of consecutive words. For each window the
postings of its rarest term, by frequency in the whole index, give the candidate places; they are intersected with the
offset-adjusted postings of the next rarest term, and what is left with those of all its terms. All of it is joins and
aggregations on the JVM; a side is broadcast only where its counted rows are under ``broadcast_rows``, and else shuffled.

Defined cases: null or wordless documents have no postings and are not hit; items without words are left out, those
without an id hit words as others do, but there is no id to list or count; of several items with one id each counts, and
the id is listed once; rows are told apart by their id and
xxhash64 of their text, so repeated rows get equal results and rows that share only the id don't mix; null ids are
compared as equal; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """Words after lower-casing A-Z; other letters keep their case."""
    plain = F.octet_length(text) == F.length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which is staged, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A term that no text has: its one posting for each row stands behind the last word, so its place is the number of words.
END = ""


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("copy"), words("text").alias("words"))


def build_index(docs: DataFrame, terms: DataFrame | None = None, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings (term, doc_id, copy, pos) of all words and END; with ``terms`` (term, tid; staged) of those, and tid in place of term."""
    postings = documents(docs, id_col, text_col).select("doc_id", "copy", F.posexplode(F.array_append("words", END)).alias("pos", "term"))
    if terms is not None:
        postings = postings.join(_small(terms, broadcast_rows), "term").select("tid", "doc_id", "copy", "pos")
    return stage(postings)


def windows(items: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged tables: windows (wid, len, terms), their items (wid, item_id), terms (term, tid)."""
    rows = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("item_id", words("text").alias("w")).where("size(w) > 0")
    each = stage(rows.select("item_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))).alias("i"), "w").select("item_id", F.slice("w", F.col("i"), size).alias("words")).distinct())
    distinct = stage(each.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()))
    named = distinct.select(F.explode("words").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id())
    terms = stage(named.unionAll(items.sparkSession.createDataFrame([(END, -1)], "term string, tid bigint")))
    used = stage(each.join(distinct, "words").select("wid", "item_id"))
    spelled = distinct.select("wid", F.posexplode("words").alias("off", "term")).join(terms, "term").select("wid", "off", "tid")
    return stage(spelled), used, terms


def phrase_matches(index: DataFrame, spelled: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(wid, len, doc_id, copy, start) of each place where all of a window's terms (wid, off, tid) stand in order."""
    frequency = stage(index.where("tid >= 0").groupBy("tid").agg(F.count("*").alias("n")))
    ranked = spelled.join(frequency, "tid", "left").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("n", "tid", "off"))).alias("r"))
    ranked = ranked.select("wid", F.size("r").alias("len"), F.col("r")[0].alias("a"), F.get("r", F.lit(1)).alias("b")).where("a.n is not null")
    plan = stage(ranked.select("wid", "len", F.col("a.tid").alias("tid"), F.col("a.off").alias("off"), F.col("b.tid").alias("tid2"), F.col("b.off").alias("off2")))
    if (plan.agg(F.max("len")).first()[0] or 0) > 62:
        raise ValueError("windows have at most 62 words")
    first = index.join(_small(plan, broadcast_rows), "tid").select("wid", "len", "doc_id", "copy", (F.col("pos") - F.col("off")).alias("start"), "tid2", "off2").where("start >= 0")
    seconds = stage(plan.where("tid2 is not null").select(F.col("tid2").alias("tid")).distinct())
    other = index.join(_small(seconds, broadcast_rows), "tid", "left_semi").select(F.col("tid").alias("t"), F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("pos").alias("p"))
    two = first.where("tid2 is not null").join(other, F.expr("tid2 = t and doc_id <=> d and copy <=> c and start + off2 = p")).select("wid", "len", "doc_id", "copy", "start")
    alone = first.where("tid2 is null").select("wid", "len", "doc_id", "copy", "start")
    found = stage(two.unionAll(alone).distinct())
    where = stage(found.select("doc_id", "copy").distinct())
    near = index.join(_small(where.select(F.col("doc_id").alias("d"), F.col("copy").alias("c")), broadcast_rows), F.expr("doc_id <=> d and copy <=> c"), "left_semi")
    near = near.select(F.col("tid").alias("t"), F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("pos").alias("p"))
    all_terms = found.join(_small(spelled, broadcast_rows), "wid")
    met = all_terms.join(near, F.expr("tid = t and doc_id <=> d and copy <=> c and start + off = p"))
    whole = F.bit_or(F.expr("shiftleft(1L, off)")) == F.expr("shiftleft(1L, len) - 1")
    return met.groupBy("wid", "len", "doc_id", "copy", "start").agg(whole.alias("whole")).where("whole").drop("whole")


def proximity_matches(index: DataFrame, spelled: DataFrame, slop: int = 20, broadcast_rows: int = 200_000) -> DataFrame:
    """(wid, doc_id, copy, pos): places of a window's rarest term with all its other terms within ``slop`` words, in any order."""
    frequency = stage(index.groupBy("tid").agg(F.count("*").alias("n")))
    distinct = spelled.select("wid", "tid").distinct().join(frequency, "tid", "left")
    ranked = stage(distinct.groupBy("wid").agg(F.count("*").alias("terms"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tid"))["tid"].alias("tid")))
    place = index.join(_small(ranked, broadcast_rows), "tid").select("wid", "terms", "doc_id", "copy", "pos")
    others = stage(spelled.select("wid", "tid").distinct())
    asked = place.join(_small(others, broadcast_rows), "wid").withColumn("cell", F.explode(F.sequence(F.expr(f"(pos - {slop}) div {slop + 1}") - 1, F.expr(f"(pos + {slop}) div {slop + 1}"))))
    held = index.select(F.col("tid").alias("t"), F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col("pos").alias("p"), F.expr(f"pos div {slop + 1}").alias("k"))
    near = asked.join(held, F.expr("tid = t and doc_id <=> d and copy <=> c and cell = k")).where(F.abs(F.col("p") - F.col("pos")) <= slop)
    return near.select("wid", "terms", "doc_id", "copy", "pos", "tid").distinct().groupBy("wid", "terms", "doc_id", "copy", "pos").count().where("count = terms").select("wid", "doc_id", "copy", "pos")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, copy, n_words, n_hit, n_items, item_ids, contaminated) for every row; item_ids sorted as strings."""
    spelled, used, terms = windows(items, size)
    index = build_index(docs, terms, broadcast_rows)
    matches = stage(phrase_matches(index, spelled, broadcast_rows))
    spans = matches.select("doc_id", "copy", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = F.max("end").over(Window.partitionBy("doc_id", "copy").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    hit = spans.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("doc_id", "copy").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))).alias("n_hit"))
    ids = matches.select("wid", "doc_id", "copy").distinct().join(used, "wid").groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    by = hit.join(ids, hit["doc_id"].eqNullSafe(ids["doc_id"]) & hit["copy"].eqNullSafe(ids["copy"])).select(hit["doc_id"].alias("d"), hit["copy"].alias("c"), "n_hit", "item_ids")
    rows = index.where("tid = -1").select("doc_id", "copy", F.col("pos").cast("bigint").alias("n_words"))
    out = rows.join(by, F.expr("doc_id <=> d and copy <=> c"), "left")
    hits = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "copy", "n_words", hits.alias("n_hit"), F.size(item_ids).cast("bigint").alias("n_items"), item_ids.alias("item_ids"), (hits > 0).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, share: float = 0.0, broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs`` without those of which more than ``share`` of the words are hit.

    Texts are shuffled only if more than ``broadcast_rows`` rows go.
    """
    found = contamination(docs, items, size, broadcast_rows).where(f"n_hit > {share} * n_words").select(F.col("doc_id").alias("_d"), F.col("copy").alias("_c")).distinct()
    found = _small(stage(found), broadcast_rows)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_d"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(found["_c"]), "left_anti")


#: The same rows in SQL for DuckDB, by joining every place of every window.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + 9] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM v
), p AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), m AS (
  SELECT doc_id, i, p.n, item_id FROM p JOIN v ON p.n = v.n AND p.g = v.g
), h AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
