"""Quality rules whose thresholds follow the corpus: quantile sketches per language and source, then joined filtering.

Every text is measured once: words, characters in words, symbols, lines that repeat an earlier one, and words in
repeated windows of three. Fixed rules refuse texts of hardly any words or of mostly repeated ones (the base). For the
others four figures are held against their own language and source, in thousandths: characters a word, symbols a word,
repeated lines of all lines, repeated words of all words.

A sketch counts the texts of a group by a figure's leading ``BITS`` binary digits, so it has a bounded number of bins,
its quantiles are right within one part in 2^(BITS-1), and sketches merge by adding counts, whatever the order. A group's
sketch is the merge of its tasks', a language's that of its sources', the corpus's that of all. A group of fewer than
``least`` texts takes its language's thresholds, a language of fewer the corpus's.

A figure may lie ``spread`` times the nearer quartile's distance from the median, and a figure's ``slack`` besides: the
nearer quartile, so that junk on one side (up to half of a group) doesn't move the threshold. Texts meet thresholds by a
join on language and source; its left side is split by a salt, as one source may hold a third of all texts.

Defined cases: null text has no words and fails the base, as does an empty one; null language and source are empty ones;
rows are judged one by one, so equal rows get equal verdicts, whatever their ids; other columns are ignored, and
:func:`select` keeps them; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, stage

BITS = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Figures, each a quotient of two measures.
FIGURES = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "repeated_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words")}
#: Thousandths by which a figure may leave its group's usual range.
SLACK = {"word_length": 500, "symbols": 100, "repeated_lines": 400, "repeated_words": 350}
#: Only words may be too short as well as too long.
TWO_SIDED = ("word_length",)


def _by_text(values: pa.Array, owner: np.ndarray, texts: int) -> np.ndarray:
    return np.bincount(owner, weights=values.to_numpy(zero_copy_only=False), minlength=texts).astype(np.int64)


def measured(texts: pa.Array) -> list[np.ndarray]:
    """The six measures of each text."""
    n = len(texts)
    texts = texts.cast(pa.large_string()).fill_null("")
    parts = pc.ascii_split_whitespace(texts)
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)  # splitting leaves empty pieces at the ends
    words, owner = words.filter(real), owner[real.to_numpy(zero_copy_only=False)]
    count = np.bincount(owner, minlength=n).astype(np.int64)
    chars = _by_text(pc.utf8_length(words), owner, n)
    symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
    cut = pc.split_pattern(texts, "\n")
    lines, of = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy().astype(np.int64)
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")
    lines, of = lines.filter(full), of[full.to_numpy(zero_copy_only=False)]
    numbered = lines.dictionary_encode()
    first = np.unique(of * (len(numbered.dictionary) + 1) + numbered.indices.to_numpy().astype(np.int64), return_index=True)[1]
    n_lines = np.bincount(of, minlength=n).astype(np.int64)
    return [count, chars, symbols, n_lines, n_lines - np.bincount(of[first], minlength=n), _repeated(words, owner, n)]


def _repeated(words: pa.Array, owner: np.ndarray, n: int) -> np.ndarray:
    """For each text its words in windows of three that it holds twice or more; words are told apart by number, not by hash."""
    if len(words) < 3:
        return np.zeros(n, np.int64)
    encoded = words.dictionary_encode()
    word, size = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
    pair = np.unique(word[:-1] * size + word[1:], return_inverse=True)[1]
    window = np.unique(pair[:-1] * size + word[2:], return_inverse=True)[1]
    at = np.flatnonzero(owner[:-2] == owner[2:])
    _, place, times = np.unique(owner[at] * len(word) + window[at], return_inverse=True, return_counts=True)
    at = at[times[place] > 1]
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(owner[covered], minlength=n).astype(np.int64)


def _measures(texts):
    parts = [texts.slice(a, b - a) for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist())]
    columns = [np.concatenate(x) for x in zip(*map(measured, parts), strict=True)] if parts else [np.zeros(0, np.int64)] * 6
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def measures(text: Column) -> Column:
    """A struct of the whole text's measures."""
    return F.arrow_udf(_measures, ", ".join(f"{m} bigint" for m in MEASURES))(text)


def base_failed(m: str = "m") -> Column:
    """Fewer than 50 words, or more than half of them repeated."""
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _figure(name: str) -> Column:
    above, below = (F.col(f"m.{c}") for c in FIGURES[name])
    return _div(above * 1000, below)


def _bin(value: Column) -> Column:
    """The smallest figure of the value's bin."""
    rest = F.greatest(F.lit(0), F.length(F.bin(value)) - BITS)
    return F.call_function("shiftleft", F.call_function("shiftright", value, rest), rest)


def sketches(measured: DataFrame) -> DataFrame:
    """(scope, lang, source, figure, bin, n): merged sketches of sources (scope 0), languages (1) and everything (2).

    ``measured`` has (lang, source, m); texts that fail the base aren't counted.
    """
    figures = F.array(*(F.struct(F.lit(f).alias("figure"), _bin(_figure(f)).alias("bin")) for f in FIGURES))
    own = measured.where(~base_failed()).select("lang", "source", F.inline(figures)).groupBy("lang", "source", "figure", "bin").agg(F.count("*").alias("n"))
    merged = own.groupingSets([["lang", "source", "figure", "bin"], ["lang", "figure", "bin"], ["figure", "bin"]], "lang", "source", "figure", "bin")
    return merged.agg(F.sum("n").alias("n"), (F.grouping("lang") + F.grouping("source")).alias("scope"))


def thresholds(measured: DataFrame, least: int = 100, spread: int = 4, slack: Mapping[str, int] = SLACK) -> DataFrame:
    """(lang, source, low_F, high_F for each figure F) for every language and source; null where the corpus has no text to go by."""
    found = sketches(measured)
    group = Window.partitionBy("scope", "lang", "source", "figure")
    upto, total = F.sum("n").over(group.orderBy("bin")), F.sum("n").over(group)
    quartiles = found.withColumns({"upto": upto, "total": total}).groupBy("scope", "lang", "source", "figure").agg(F.max("total").alias("total"), *(F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bin"))).alias(f"q{k}") for k in (1, 2, 3)))
    room = F.create_map(*(F.lit(x) for f in FIGURES for x in (f, slack[f])))[F.col("figure")]
    width = spread * F.least(F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2")) + room
    low = F.when(F.col("figure").isin(*TWO_SIDED), F.col("q2") - width)
    bounds = quartiles.groupBy("scope", "lang", "source").agg(F.max("total").alias("total"), *(F.max(F.when(F.col("figure") == f, x)).alias(f"{side}_{f}") for f in FIGURES for side, x in (("low", low), ("high", F.col("q2") + width))))
    columns = [f"{side}_{f}" for f in FIGURES for side in ("low", "high")]
    row = F.struct("total", *columns)
    groups = measured.select("lang", "source").distinct()
    own = bounds.where("scope = 0").select("lang", "source", row.alias("own"))
    of_lang = bounds.where("scope = 1").select("lang", row.alias("of_lang"))
    whole = bounds.where("scope = 2").select(row.alias("whole"))
    # `whole` is a single row
    out = groups.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left").join(whole, F.lit(True), "left")
    enough = lambda c: F.col(f"{c}.total") >= least
    taken = F.when(enough("own"), F.col("own")).when(enough("of_lang"), F.col("of_lang")).otherwise(F.col("whole"))
    return out.select("lang", "source", taken.alias("t")).select("lang", "source", *(f"t.{c}" for c in columns))


def broken() -> Column:
    """Names of the figures beyond their thresholds."""
    names = []
    for f in FIGURES:
        beyond = (_figure(f) > F.col(f"high_{f}")) | F.coalesce(_figure(f) < F.col(f"low_{f}"), F.lit(False))
        names.append(F.when(F.coalesce(beyond, F.lit(False)), f))
    return F.when(base_failed(), F.lit("")).otherwise(F.concat_ws(",", *names))


def _text_group(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _judged(rows: DataFrame, limits: DataFrame, salts: int) -> DataFrame:
    """``rows`` (lang, source, m, ...) with base_failed, rules and kept."""
    limits = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("m"), F.lit(salts)).cast("int")).join(limits, ["lang", "source", "salt"], "left")
    return met.withColumn("base_failed", base_failed()).withColumn("rules", broken()).withColumn("kept", ~F.col("base_failed") & (F.col("rules") == ""))


def judge(docs: DataFrame, least: int = 100, spread: int = 4, slack: Mapping[str, int] = SLACK, salts: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the measures, base_failed, rules, kept) for every row; rules names the figures beyond their thresholds."""
    rows = stage(small_batches(docs).select(F.col(id_col).alias("id"), _text_group("lang").alias("lang"), _text_group("source").alias("source"), measures(F.col(text_col).cast("string")).alias("m")))
    limits = stage(thresholds(rows, least, spread, slack))
    return _judged(rows, limits, salts).select("id", "m.*", "base_failed", "rules", "kept")


def select(docs: DataFrame, least: int = 100, spread: int = 4, slack: Mapping[str, int] = SLACK, salts: int = 16, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; texts are measured again, so they aren't shuffled by id."""
    found = small_batches(docs).select(_text_group("lang").alias("lang"), _text_group("source").alias("source"), measures(F.col(text_col).cast("string")).alias("m"))
    limits = stage(thresholds(stage(found), least, spread, slack))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), _text_group("lang").alias("lang"), _text_group("source").alias("source"), measures(F.col(f"`{text_col}`").cast("string")).alias("m"))
    return _judged(rows, limits, salts).where("kept").select("row.*")


def _sql_bin(value: str) -> str:
    shift = f"greatest(0, length(bin({value})) - {BITS})"
    return f"(({value}) >> {shift}) << {shift}"


def _oracle(least: int = 100, spread: int = 4) -> str:
    """The contract of op13, and this module's thresholds, in SQL for DuckDB."""
    figures = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS figure, {_sql_bin(f)} AS bin FROM sound" for f in FIGURES)
    quotients = ", ".join(f"1000 * {a} // {b} AS {f}" for f, (a, b) in FIGURES.items())
    slack = " ".join(f"WHEN '{f}' THEN {SLACK[f]}" for f in FIGURES)
    bad = {f: f"{f} > q2_{f} + w_{f}" + (f" OR {f} < q2_{f} - w_{f}" if f in TWO_SIDED else "") for f in FIGURES}
    named = ", ".join(f"CASE WHEN {b} THEN '{f}' END" for f, b in bad.items())
    joined = " ".join(f"LEFT JOIN picked {f}_p ON {f}_p.lang = g.lang AND {f}_p.source = g.source AND {f}_p.figure = '{f}'" for f in FIGURES)
    columns = ", ".join(f"{f}_p.q2 AS q2_{f}, {f}_p.width AS w_{f}" for f in FIGURES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
listed AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM listed),
windows AS (SELECT r, pos, row(word, lead(word) OVER o, lead(word, 2) OVER o) AS x, lead(pos, 2) OVER o IS NOT NULL AS whole FROM words WINDOW o AS (PARTITION BY r ORDER BY pos)),
often AS (SELECT r, pos FROM windows WHERE whole QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, count(DISTINCT pos + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
measured AS (
  SELECT d.r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM listed d LEFT JOIN covered c USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
sound AS (SELECT *, {quotients} FROM judged WHERE NOT base_failed),
bins AS ({figures}),
sums AS (SELECT lang, source, figure, bin, count(*) AS n, grouping(lang) + grouping(source) AS scope FROM bins GROUP BY GROUPING SETS ((lang, source, figure, bin), (lang, figure, bin), (figure, bin))),
running AS (SELECT *, sum(n) OVER (g ORDER BY bin) AS upto, sum(n) OVER g AS total FROM sums WINDOW g AS (PARTITION BY scope, lang, source, figure)),
quartiles AS (SELECT scope, lang, source, figure, max(total) AS total, min(bin) FILTER (4 * upto >= total) AS q1, min(bin) FILTER (4 * upto >= 2 * total) AS q2, min(bin) FILTER (4 * upto >= 3 * total) AS q3 FROM running GROUP BY ALL),
wide AS (SELECT *, {spread} * least(q2 - q1, q3 - q2) + CASE figure {slack} END AS width FROM quartiles),
groups AS (SELECT DISTINCT lang, source FROM docs),
picked AS (
  SELECT g.lang, g.source, q.figure, arg_min(q.q2, scope) AS q2, arg_min(q.width, scope) AS width FROM groups g
  JOIN wide q ON scope = 2 OR (q.lang = g.lang AND (scope = 1 OR q.source = g.source)) WHERE q.total >= {least} OR scope = 2 GROUP BY ALL),
limits AS (SELECT g.lang, g.source, {columns} FROM groups g {joined}),
ruled AS (SELECT r, concat_ws(',', {named}) AS rules FROM sound JOIN limits USING (lang, source))
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, coalesce(rules, '') AS rules, NOT base_failed AND coalesce(rules, '') = '' AS kept
FROM judged LEFT JOIN ruled USING (r)
"""


ORACLE = _oracle()
