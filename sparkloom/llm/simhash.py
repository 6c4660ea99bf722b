"""SimHash near-duplicates with multi-index hashing.

A fingerprint has 64 bits, one for each position in which over half of the shingles' XXH64 values have a one.
Two fingerprints within ``radius`` (at most 3) differ in at most ``radius // 2`` bits in one of their halves, so each
fingerprint looks up, for either half, the small Hamming ball around its own value in a table of that half, and
complete distances are verified. Equal fingerprints are one row there, so groups of copies cost one row.

A half's value that very many different fingerprints hold (``dense``) isn't joined pair by pair. There, fingerprints
meet at points of the other half: if x lies within s of a point and y within t of it, and s + t plus their
distance in this half is at most ``radius``, they link; every x at the point is tied to one such y, every y to one such x.
That joins the same components with rows in proportion to the fingerprints.

Defined cases: null or blank text has fingerprint zero and links like any other; rows without a doc_id get a component
of the smallest non-null doc_id they reach, null if none; repeated rows and repeated ids are separate rows; columns
besides the two that are used are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stage, unstage, utf8
from .graph import connected_components, drawn_together

BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    last = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for begin in range(0, last, BLOCK):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(begin, min(last, begin + BLOCK))]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x, shingle) for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp bigint")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _masks(radius: int) -> Column:
    return F.explode(F.array(*(F.lit(m).cast("bigint") for m in ball(32, radius))))


def links(fps: DataFrame, radius: int = 3, dense: int = 256) -> DataFrame:
    """Edges (a, b) among the distinct values of column fp; they join what lies within ``radius`` bits.

    Spark takes an exploded table for as small as it was before, and rows that repeat a value for as small as their file,
    so joins of balls are merge joins by hint: none of them is broadcast.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius is 0 to 3")
    near = radius // 2
    half = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    table = stage(fps.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), half[s].alias("val"), half[1 - s].alias("rest")) for s in (0, 1)))).alias("x")).select("fp", "x.*"))
    crowded = stage(table.groupBy("seg", "val").count().where(F.col("count") >= dense).select("seg", F.col("val").alias("key")))
    probes = table.select("seg", "fp", "val", "rest", _masks(near).alias("mask")).select("seg", "fp", "rest", F.col("val").bitwiseXOR(F.col("mask")).alias("key"), (F.bit_count("mask")).alias("off"))
    some = bool(crowded.head(1))
    light = probes.join(crowded, ["seg", "key"], "left_anti") if some else probes
    pairs = (
        light.hint("merge").join(table.select("seg", F.col("val").alias("key"), F.col("fp").alias("other")).hint("merge"), ["seg", "key"])
        .where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
        .select(F.col("fp").alias("a"), F.col("other").alias("b"))
    )
    if not some:
        return pairs.distinct()
    heavy = stage(probes.join(crowded, ["seg", "key"], "left_semi"))
    # side x holds the crowded value itself, side y differs from it in `off` bits; the rest of the distance is shared out
    points = None
    for off in range(near + 1):
        left = radius - off
        for side, rows, reach in (("x", heavy.where("off = 0"), left - left // 2), ("y", heavy.where(F.col("off") == off), left // 2)):
            at = rows.select("seg", "key", F.lit(off).alias("off"), F.lit(side).alias("side"), "fp", "rest", _masks(reach).alias("mask"))
            at = at.select("seg", "key", "off", F.col("rest").bitwiseXOR(F.col("mask")).alias("point"), "side", "fp")
            points = at if points is None else points.unionAll(at)
    points = stage(points)
    keys = ["seg", "key", "off", "point"]
    met = stage(points.groupBy(*keys).agg(F.min(F.when(F.col("side") == "x", F.col("fp"))).alias("x"), F.min(F.when(F.col("side") == "y", F.col("fp"))).alias("y")).where("x is not null and y is not null"))
    tied = points.hint("merge").join(met.hint("merge"), keys).select(F.col("fp").alias("a"), F.when(F.col("side") == "x", F.col("y")).otherwise(F.col("x")).alias("b"))
    return pairs.unionAll(tied.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, dense: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most ``radius`` bits."""
    rows = stage(fingerprints(docs, shingle, id_col, text_col))
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("first")))
    groups = connected_components(links(distinct.select("fp"), radius, dense))
    root = F.coalesce("component", "fp")
    rooted = stage(distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", root.alias("root"), "first"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = stage(rooted.join(least, "root").select("fp", "component"))
    unstage(distinct)
    return rows.join(named, "fp").select("id", "fp", "component")


def hex64(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Groups by similarity: copies whose shingles overlap by four fifths differ in far more than three of 64 bits, so the
# deduplicating stage takes 1,024 bits and a share of differing bits instead. Segments of those bits would have to be
# longer, and so weaker, the more rows there are; rows meet in bands of smallest shingle hashes, whose recall is the
# same at every size. What bands and bits miss (of short texts they would miss half at the limit) is found by prefixes.

WIDE = 16
#: Bands of so many smallest hashes: sets of Jaccard similarity s share a band with 1 - (1 - s ** BAND) ** BANDS, which is
#: 0.999 at 0.8 and 0.14 at 0.5, however many rows there are.
BANDS, BAND = 40, 8
_FACTORS, _SHIFTS = np.random.RandomState(42).randint(0, 1 << 32, (2, BANDS * BAND, 1), np.uint64).astype(np.uint32)
_FACTORS |= np.uint32(1)
_MIXERS = np.array([0x9E3779B97F4A7C15 + 2 * k for k in range(1, WIDE)], np.uint64)
WORDS = [f"f{k}" for k in range(WIDE)]
#: Leading bits of shingle hashes that tell common ones from others.
PLACES = 21


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of the different shingles of one text, ascending."""
    words = (text or b"").lower().split()
    last = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(last)), np.uint64, last))


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, ...]:
    """Sixteen signed 64-bit SimHash words of shingle hashes; the further words' hashes are mixed from the first's."""
    ones = np.zeros(64 * WIDE, np.int64)
    for begin in range(0, len(hashes), 255):  # so few rows that their ones can be added up in a byte
        h = hashes[begin : begin + 255, None]
        more = (h ^ (h >> np.uint64(31))) * _MIXERS
        wide = np.hstack((h, more ^ (more >> np.uint64(29)))).astype(">u8")
        ones += np.add.reduce(np.unpackbits(wide.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return tuple(np.packbits(ones * 2 > len(hashes)).view(">i8").tolist())


def bands(hashes: np.ndarray) -> list[int]:
    """The places where a set of shingle hashes meets others; none for an empty one."""
    if not len(hashes):
        return []
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(high), 2048):
        np.minimum(least, (_FACTORS * high[begin : begin + 2048] + _SHIFTS).min(1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, BAND))]


def _whole(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def common_shingles(docs: DataFrame, shingle: int = 5, one_in: int = 16, often: int = 3, text_col: str = "text") -> np.ndarray:
    """Which of the ``2 ** PLACES`` places of shingle hashes hold one that ``often`` of the different sampled texts have.

    It only orders the shingles of a set, the same way for all of them, so no result depends on the sample.
    """
    text = F.col(text_col).cast("string")
    sampled = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    sets = shingle_sets(sampled, shingle).dropDuplicates(["whole"]).select(F.explode("shingles").alias("h"))
    places = sets.groupBy("h").count().where(F.col("count") >= often).select(F.shiftrightunsigned("h", 64 - PLACES).alias("place")).distinct()
    common = np.zeros(1 << PLACES, bool)
    common[places.toArrow().column(0).to_numpy()] = True
    return common


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """So many shingles of a set, the uncommon ones first, that any set of at least that similarity has one of them among its own.

    A set of n shares ``similarity * n`` shingles or more with such a set, so it shares one of any n less that, and one.
    Shingles are in one order for all sets, so the first that is shared is among the first of both.
    """
    most = len(hashes) - max(0, int(np.ceil(similarity * len(hashes) - 1e-9)) - 1)
    late = common[(hashes >> np.uint64(64 - PLACES)).astype(np.int64)]
    return np.concatenate((hashes[~late], hashes[late]))[:most]


def wide_fingerprints(docs: DataFrame, similarity: float, common: np.ndarray, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, copy, whole, cells, prefix, rest, f0 to f15) for every row; equal texts have equal ``copy``, equal sets equal
    ``whole``; ``rest`` shingles aren't in ``prefix``."""
    names = ["id", "copy", "whole", "cells", "prefix", "rest", *WORDS]
    common = np.packbits(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(common).view(bool)
        for batch in batches:
            hashes = [shingle_hashes(x, shingle) for x in utf8(batch.column(2))]
            fps = np.array([wide_fingerprint(h) for h in hashes], np.int64).reshape(-1, WIDE)
            first = [prefix(h, similarity, late) for h in hashes]
            more = [pa.array([_whole(h) for h in hashes], pa.binary()), pa.array([bands(h) for h in hashes], pa.list_(pa.int64())), pa.array([x.view(np.int64) for x in first], pa.list_(pa.int64())), pa.array([len(h) - len(x) for h, x in zip(hashes, first, strict=True)], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more, *(pa.array(fps[:, k]) for k in range(WIDE))], names=names)

    rows = small_batches(docs).select(F.col(id_col).alias("id"), _copy(text_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, copy bigint, whole binary, cells array<bigint>, prefix array<bigint>, rest int, " + ", ".join(f"{w} bigint" for w in WORDS))


def _copy(text_col: str) -> Column:
    """What tells the texts of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string")).alias("copy")


def _limited(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which is staged, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shingle_sets(docs: DataFrame, shingle: int = 5, text_col: str = "text") -> DataFrame:
    """(whole, shingles) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in slices([len(x or b"") for x in texts]):
                hashes = [shingle_hashes(x, shingle) for x in texts[a:b]]
                ends = pa.array(np.cumsum([0, *map(len, hashes)]).astype(np.int32))
                sets = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_whole(h) for h in hashes], pa.binary()), sets], names=["whole", "shingles"])

    return small_batches(docs).select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "whole binary, shingles array<bigint>")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) of nodes whose sets (node, shingles) have at least that Jaccard similarity."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set")) for x in ("a", "b"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(a, "a").join(b, "b").where(both / (F.size("a_set") + F.size("b_set") - both) >= similarity).select("a", "b")


def _apart(other: str) -> Column:
    """Number of bits in which a row's fingerprint differs from the one whose columns have that prefix."""
    return sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{other}{w}"))) for w in WORDS), F.lit(0))


def unjoined(nodes: DataFrame, joined: DataFrame | None, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes in different components (``joined``) that may have that Jaccard similarity; none that has is missing.

    Nodes meet where they share a shingle of their prefixes (:func:`prefix`). Two nodes share no more shingles than they
    share of their prefixes and as many as one of them has beyond its own, which must do for the similarity. Shingles
    whose nodes are all in one component are done; a node can share no more of its prefix than are left, so groups of
    texts that each have much of their own don't meet pair by pair.
    """
    rows = nodes.select("node", "prefix", "rest", (F.size("prefix") + F.col("rest")).alias("n"))
    rows = rows.withColumn("comp", F.col("node")) if joined is None else rows.join(joined.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    table = rows.select("node", "comp", "n", "rest", F.explode("prefix").alias("key"))
    several = table.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("key")
    live = stage(table.hint("merge").join(several.hint("merge"), "key"))
    live = stage(live.hint("merge").join(live.groupBy("node").agg(F.count("*").alias("open")).hint("merge"), "node"))
    others = live.select("key", *(F.col(c).alias(f"b_{c}") for c in ("node", "comp", "n", "rest", "open")))
    rest = F.greatest("rest", "b_rest")
    wanted = similarity / (1 + similarity) * (F.col("n") + F.col("b_n")) - 1e-6
    fits = (F.least("n", "b_n") >= similarity * F.greatest("n", "b_n") - 1e-6) & (F.least("open", "b_open") + rest >= wanted)
    met = live.hint("merge").join(others.hint("merge"), "key").where((F.col("node") < F.col("b_node")) & (F.col("comp") != F.col("b_comp")) & fits)
    shared = met.groupBy(F.col("node").alias("a"), F.col("b_node").alias("b")).agg(F.count("*").alias("shared"), F.first(wanted - rest).alias("least"))
    return shared.where("shared >= least").select("a", "b")


def similar_groups(nodes: DataFrame, most: int, similarity: float, verify: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame | None:
    """(node, component) of the nodes that link; None if there are none.

    ``nodes`` (node, first, cells, prefix, rest, f0 to f15) is staged. Nodes link where ``verify`` keeps their pair. First,
    in ``rounds`` rounds, the nodes of a place (``cells``) meet one leader of it (the smallest ``first``, then by a hash) if
    they differ in ``most`` bits or fewer, which joins large groups without their pairs; places all of whose nodes are in
    one component are done. After the first round a node has one that it is joined with, after the last its component, so
    components aren't made anew from all links. Then every pair of different components that may be similar is verified
    (:func:`unjoined`), so neither places nor fingerprints decide on a link.
    """
    table = nodes.select("node", "first", F.explode("cells").alias("key"))
    prints = nodes.select("node", *WORDS)
    ends = prints.select(F.col("node").alias("other"), *(F.col(w).alias(f"b_{w}") for w in WORDS))

    def led(rows: DataFrame, order: Column) -> DataFrame:
        """Places with several components, and the node ``other`` and component ``b_comp`` that lead each."""
        by = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min_by("node", order).alias("other"), F.min_by("comp", order).alias("b_comp"))
        return by.where("x != y").select("key", "other", "b_comp").hint("merge")

    live = stage(table.select("node", "key").withColumn("comp", F.col("node")).join(led(table.withColumn("comp", F.col("node")), F.col("first")), "key"))
    edges = tried = None
    for turn in range(rounds):
        met = live.where("comp != b_comp").select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other")).distinct()
        near = met.join(prints, "node").join(ends, "other").where(_apart("b_") <= most)
        pairs = near.select(F.col("node").alias("a"), F.col("other").alias("b"))
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs
        new = stage(verify(pairs)) if pairs.head(1) else pairs
        edges = new if edges is None else edges.unionAll(new)
        if turn + 1 == rounds or not new.head(1):
            break
        edges = drawn_together(edges)
        groups = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        named = stage(live.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")))
        live = stage(named.join(led(named, F.xxhash64("node", "key", F.lit(turn))), "key"))
        if not live.head(1):
            break
    joined = stage(connected_components(edges)) if edges.head(1) else None
    pairs = stage(unjoined(nodes, joined, similarity))
    new = stage(verify(pairs)) if pairs.head(1) else pairs
    if not new.head(1):
        return joined
    return connected_components(new if joined is None else joined.where("node != component").unionAll(new))


def keep_first(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are near copies of a row with a smaller id, directly or over others.

    Rows link where the Jaccard similarity of their sets of ``shingle``-word shingles is at least ``similarity``, which
    is verified for every link. SimHash over the different shingles joins most of a group first: pairs are tried if they
    differ by at most three standard deviations more bits than sets of that similarity are expected to differ by. What
    it misses is then found by prefixes of the sets, which lose no pair of that similarity. Rows without an id
    are kept; rows of one id with different texts are judged each by its own text, and those of one id and one text stay
    or go together. Blank and null texts are copies of one another. Texts are shuffled only if more than
    ``broadcast_rows`` rows go.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    most = int(np.ceil(p * 64 * WIDE + 3 * np.sqrt(p * (1 - p) * 64 * WIDE)))
    rows = stage(wide_fingerprints(docs, similarity, common_shingles(docs, shingle, text_col=text_col), shingle, id_col, text_col))
    sets = rows.where("id is not null").groupBy("whole").agg(F.min("id").alias("first"), *(F.first(c).alias(c) for c in ("cells", "prefix", "rest")), *(F.first(w).alias(w) for w in WORDS))
    nodes = stage(sets.withColumn("node", F.monotonically_increasing_id()))

    def verify(pairs: DataFrame) -> DataFrame:
        # sets are made anew for the nodes of pairs, as those of all rows are larger than the texts
        asked = stage(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct().join(nodes.select("node", "first", "whole"), "node"))
        ids = _limited(stage(asked.select(F.col("first").alias("_first")).distinct()), broadcast_rows)
        texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, F.col("_id") == F.col("_first"), "left_semi")
        found = shingle_sets(texts, shingle, "_text").join(asked.select("whole", "node"), "whole").dropDuplicates(["node"])
        return alike(pairs, stage(found.select("node", "shingles")), similarity)

    groups = similar_groups(nodes, most, similarity, verify)
    firsts = nodes.select("whole", "first", "node")
    if groups is None:
        kept = firsts.select("whole", "first", F.col("first").alias("least"))
    else:
        named = stage(firsts.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
        kept = named.join(named.groupBy("component").agg(F.min("first").alias("least")), "component").select("whole", "first", "least")
    # a set keeps its smallest id only if that is also the smallest of its group
    gone = rows.where("id is not null").select("id", "copy", "whole").join(kept, "whole").where("id != least").select(F.col("id").alias("_id"), F.col("copy").alias("_copy")).distinct()
    gone = _limited(stage(gone), broadcast_rows)
    return docs.join(gone, (docs[id_col] == gone["_id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["_copy"]), "left_anti")
