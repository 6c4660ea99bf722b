"""Personal data by weak supervision.

Base spans come from the strict patterns (email, ip, card, phone) with their checks; they are always kept. Beside them,
candidates are anything of roughly such a shape, also inside what a base pattern took too much of: groups of digits
within a longer run, the beginning of a longer phone-like run, four parts of a longer dotted run, addresses that spell
out "at" and "dot" or have spaces around them, IPv6 addresses, and phones without a plus. On each candidate labelers
vote for, against, or not at all:

* regex: its exact shape; a failed check (checksum, number of digits, octets, a cut through a number) is certain and
  makes the span a known negative;
* gazetteer: known card issuers and their lengths, dialling codes, top-level domains and mail providers, address ranges;
* context: words around it that announce such data, or that announce something else (versions, hashes, orders).

Expectation-maximisation over the counted vote patterns estimates each labeler's reliability and each pattern's
probability; there are at most 4 kinds x 3^3 patterns, whatever the corpus. The final span classifier, a logistic
regression on features of the span itself (shape, checksum, length, separators, neighbouring characters and words) and
not on the votes, is trained on these soft labels, on a sample of about ``sample`` candidates with equal shares for each
vote pattern, weighted by the patterns' counts. Candidates that it takes for personal data and that don't overlap a base
span are added; of overlapping ones the likelier stays.

Defined cases: null text is empty; places are code points with an exclusive end; with no candidates nothing is added;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, product
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context")

# The base patterns. Starts that a leftmost match can't have are ruled out, which keeps them linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# What candidates look like.
SPELLED_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(] ?at ?[\])] ?| @ ?|@ )[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
PLAIN_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
DOTTED = re.compile(r"(?<![0-9.])[0-9]+(?:\.[0-9]+){3,}")
COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{4,39}(?![0-9A-Za-z:])")
# What the labelers know.
ISSUERS = [("4", (13, 16, 19)), ("5[1-5]", (16,)), ("2(?:22[1-9]|2[3-9][0-9]|[3-6]|7[01]|720)", (16,)), ("3[47]", (15,)), ("3(?:0[0-5]|[689])", (14, 16)), ("6(?:011|4[4-9]|5)", (16, 17, 18, 19)), ("35(?:2[89]|[3-8])", (16, 17, 18, 19)), ("62", (16, 17, 18, 19)), ("5[06-8]|6", (14, 15, 16, 17, 18, 19))]
ISSUERS = [(re.compile(p), n) for p, n in ISSUERS]
DIALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 381 385 386 420 421 852 886 966 971 972".split())
TOP_LEVEL = frozenset("com org net edu gov mil int info biz name io co app dev me tv uk de fr es it nl ch at be us eu ca au jp cn in br mx ru pl pt se no dk fi ie cz gr".split())
PROVIDERS = frozenset("gmail googlemail yahoo hotmail outlook live icloud aol gmx web mail protonmail proton zoho yandex".split())
ANNOUNCE = {
    "email": frozenset("email e-mail mail mailto contact write reach correo courriel".split()),
    "ip": frozenset("ip ipv6 address host server client from login addr adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit payment pay karte carte tarjeta cc".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon téléphone teléfono contact".split()),
}
DENY = frozenset("version release build sha md5 hash token key order invoice isbn issn serial sku id ref number no tracking".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if at >= last and (m := DOMAIN.match(text, at)):
            begin = at
            while begin > last and text[begin - 1] in LOCAL_CHARS:
                begin -= 1
            if begin < at:
                out.append((begin, m.end()))
                last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _octet(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        out += [(*m.span(), "card") for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _groups(begin: int, found: str, least: int, most: int, first: bool = False) -> Iterator[tuple[int, int]]:
    """Spans of consecutive digit groups of ``found`` that hold so many digits in all; ``first``: from its start only."""
    parts = [m.span() for m in re.finditer("[0-9]+", found)]
    for i in range(1 if first else len(parts)):
        n = 0
        for a, b in parts[i:]:
            n += b - a
            if n > most:
                break
            if n >= least:
                yield begin + (0 if first else parts[i][0]), begin + b


def _loose(text: str) -> Iterator[tuple[int, int, str]]:
    if re.search("[0-9]", text):
        for m in CARD.finditer(text):
            for a, b in _groups(m.start(), m[0], 13, 19):
                yield a, b, "card"
        for m in PHONE.finditer(text):
            for a, b in _groups(m.start(), m[0], 10, 15, first=True):
                yield a, b, "phone"
        for m in PLAIN_PHONE.finditer(text):
            if not re.search(r"\+[0-9]{1,3}[ .-]?$", text[max(0, m.start() - 5) : m.start()]):  # else it is part of the one before
                yield *m.span(), "phone"
        for m in DOTTED.finditer(text):
            parts = [p.span() for p in re.finditer("[0-9]+", m[0])]
            for first, last in zip(parts, parts[3:], strict=False):
                yield m.start() + first[0], m.start() + last[1], "ip"
    if "::" in text or text.count(":") > 6:
        for m in COLONS.finditer(text):
            if m[0].count("::") <= 1 and ":::" not in m[0] and all(len(x) <= 4 for x in m[0].split(":")) and (m[0].count(":") == 7 or "::" in m[0] and re.search("[0-9A-Fa-f]", m[0])):
                yield *m.span(), "ip"
    if "@" in text or "at" in text and ("[" in text or "(" in text):
        for m in SPELLED_MAIL.finditer(text):
            yield *m.span(), "email"


def _neighbour(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "\"'`=_/+" else 5


def _known(found: str, kind: str) -> int:
    """The gazetteer's vote."""
    digits = _digits(found)
    if kind == "card":
        return 1 if any(p.match(digits) and len(digits) in n for p, n in ISSUERS) else -1
    if kind == "ip":
        if ":" in found:
            return 1 if found[:1] in "23fF" else 0
        first = int(found.split(".")[0][-4:])
        return 1 if 0 < first < 224 else -1
    if kind == "phone":
        if found[0] == "+" or found.startswith("00"):
            code = digits[2 * (found[0] != "+") :]
            return 1 if any(code.startswith(x) for x in (code[:1], code[:2], code[:3]) if x in DIALLING) else -1
        return 1 if digits[0] in "23456789" else -1
    labels = re.findall(r"[A-Za-z0-9-]+", re.sub(r"(?i)[\[(] ?(?:at|dot) ?[\])]", " ", found))
    return 1 if labels[-1].lower() in TOP_LEVEL or labels[-2:-1] and labels[-2].lower() in PROVIDERS else -1 if labels[-1].isdigit() else 0


def _shaped(found: str, kind: str, before: int, after: int) -> int:
    """The pattern labeler's vote; -1 where a check fails that any such data must pass."""
    digits, groups = _digits(found), [len(x) for x in re.findall("[0-9]+", found)]
    cut = before == 3 or after == 3
    glued = before == 2 or after == 2
    if kind == "card":
        if cut or glued or not luhn(digits) or not 14 <= len(digits) <= 19:
            return -1
        return 1 if len(groups) == 1 or groups in ([4] * 4, [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3]) else 0
    if kind == "ip":
        if cut or ":" not in found and not all(map(_octet, found.split("."))):
            return -1
        return 0 if glued or ":" not in found and any(len(p) > 1 and p[0] == "0" for p in found.split(".")) else 1
    if kind == "phone":
        if cut or not 10 <= len(digits) <= 15:
            return -1
        return 1 if not glued and re.search(r"\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}$", found) else 0
    return -1 if ".." in found or not re.search("[A-Za-z]{2,}$", found) else 1 if len(found) <= 80 else 0


SIDE = 32
#: Features of a kind: 1 always, 5 of what the span is, 20 lengths, 6 separators, 6 characters before and after it each, words before and after it.
OF_KIND = 1 + 5 + 20 + 6 + 6 + 6 + 3 * SIDE


def _described(text: str, begin: int, end: int, kind: str) -> tuple[list[int], list[int]]:
    """Votes and features (numbers of those that hold) of one span."""
    found, digits = text[begin:end], _digits(text[begin:end])
    ends = _neighbour(text[begin - 1 : begin]), _neighbour(text[end : end + 1])
    # words stand apart from the span, so a glued one isn't cut in two
    left = re.findall(r"[^\W_][\w-]*", text[max(0, begin - 48) : begin].lower())[-4:]
    right = re.findall(r"[^\W_][\w-]*", text[end : end + 32].lower())[:2]
    announced, denied = any(w in ANNOUNCE[kind] for w in (*left, *right)), any(w in DENY for w in left[-2:])
    votes = [_shaped(found, kind, *ends), _known(found, kind), 1 if announced else -1 if denied else 0]
    separators = set(re.sub("[0-9A-Za-z]", "", found)) - {"@", "."} if kind == "email" else set(re.sub("[0-9A-Fa-f+]", "", found))
    size = len(digits) if kind in ("card", "phone") else len(found.split(".")[0]) if kind == "ip" else len(found) // 8
    own = [luhn(digits) if kind == "card" else False, votes[1] > 0, votes[1] < 0, found[0] == "+", ":" in found]
    out = [0, *(1 + i for i, x in enumerate(own) if x), 6 + min(size, 19)]
    out += [26 + (0 if not separators else 5 if len(separators) > 1 else {" ": 1, "-": 2, ".": 3}.get(next(iter(separators)), 4)), 32 + ends[0], 38 + ends[1]]
    out += sorted({44 + side * SIDE + zlib.crc32(w.encode()) % SIDE for side, words in enumerate((left[-1:], left[-2:-1], right[:1])) for w in words})
    return votes, [KINDS.index(kind) * OF_KIND + i for i in out]


Span = tuple[int, int, str, bool, list[int], list[int]]


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[Span]:
    """(start, end, kind, is base, votes, features) of the base spans and of what else has roughly such a shape."""
    starts, reach = [a for a, *_ in base], list(accumulate((b for _, b, _ in base), max))
    loose = set()
    for a, b, kind in _loose(text):
        before = bisect_left(starts, b)  # base spans that begin before its end; it is free if they all end before its start
        if not before or reach[before - 1] <= a:
            loose.add((a, b, kind))
    spans = [(*s, True) for s in base] + [(*s, False) for s in sorted(loose)]
    return [(a, b, k, own, *_described(text, a, b, k)) for a, b, k, own in spans]


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability of each (kind, votes) by expectation-maximisation over their counts; kinds have their own reliabilities.

    A labeler has, for either truth, a probability of each vote; they start from the votes being right four times in five.
    Patterns in which the first labeler votes against are known negatives.
    """
    out = {}
    for kind in KINDS:
        own = [(v, n) for k, v, n in patterns if k == kind]
        if not own:
            continue
        votes, counts = np.array([v for v, _ in own]) + 1, np.array([n for _, n in own], float)
        labelers = range(votes.shape[1])
        rate = np.array([[[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]]] * len(labelers))  # labeler, truth, vote
        prior = 0.5
        for _ in range(rounds):
            chance = np.array([np.log([1 - prior, prior][t]) + sum(np.log(rate[j, t, votes[:, j]]) for j in labelers) for t in (0, 1)])
            p = np.where(votes[:, 0] == 0, 0, 1 / (1 + np.exp(np.clip(chance[0] - chance[1], -50, 50))))
            prior = float(np.clip((p * counts).sum() / counts.sum(), 0.02, 0.98))
            for j, t in product(labelers, (0, 1)):
                weight = (p if t else 1 - p) * counts
                seen = np.bincount(votes[:, j], weights=weight, minlength=3) + 4 * np.array([[0.6, 0.25, 0.15], [0.15, 0.25, 0.6]])[t]
                rate[j, t] = seen / seen.sum()
        out |= {(kind, v): float(x) for (v, _), x in zip(own, p, strict=True)}
    return out


def fit(features: list[list[int]], soft: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights of the span classifier by Adam on the weighted log likelihood of soft labels."""
    out = np.zeros(len(KINDS) * OF_KIND)
    if not features:
        return out
    index = np.concatenate([np.array(x, np.int64) for x in features])
    owner = np.repeat(np.arange(len(features)), [len(x) for x in features])
    share = weight / weight.sum()
    m, v = np.zeros_like(out), np.zeros_like(out)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.bincount(owner, weights=out[index], minlength=len(features))))
        slope = np.bincount(index, weights=((p - soft) * share)[owner], minlength=len(out)) + l2 * out
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope * slope
        out -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return out


FIELDS = ("start", "end", "kind", "base", "votes", "features")


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, spans): every candidate with its votes and features."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("votes", pa.list_(pa.int8())), ("features", pa.list_(pa.int16()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans.append([dict(zip(FIELDS, c, strict=True)) for c in candidates(text, base_spans(text))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["id", "spans"])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, spans array<struct<start: bigint, end: bigint, kind: string, base: boolean, votes: array<tinyint>, features: array<smallint>>>")


def _weights(found: DataFrame, sample: int) -> np.ndarray:
    spans = found.select("id", F.explode("spans").alias("s")).select("id", "s.kind", "s.votes", "s.features", "s.start")
    counted = sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in spans.groupBy("kind", "votes").count().collect())
    soft = estimate(counted)
    if not counted:
        return fit([], np.zeros(0), np.zeros(0))
    # each pattern gets an equal share of the sample, by a hash; what it counts for is its number of spans
    share = {(k, v): min(1.0, sample / len(counted) / n) for k, v, n in counted}
    of = found.sparkSession.createDataFrame([(k, list(v), share[k, v]) for k, v, _ in counted], "kind string, votes array<tinyint>, share double")
    chance = F.xxhash64("id", "start", "features").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    taken = spans.join(F.broadcast(of), ["kind", "votes"]).where(chance < F.col("share")).groupBy("kind", "votes", "features").count().collect()
    taken.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))
    held: dict[tuple, int] = {}
    for r in taken:
        held[r["kind"], tuple(r["votes"])] = held.get((r["kind"], tuple(r["votes"])), 0) + r["count"]
    total = {(k, v): n for k, v, n in counted}
    keys = [(r["kind"], tuple(r["votes"])) for r in taken]
    # logarithms, so that a rare pattern isn't drowned
    weight = np.array([r["count"] / held[k] * log(1 + total[k]) for r, k in zip(taken, keys, strict=True)])
    return fit([r["features"] for r in taken], np.array([soft[k] for k in keys]), weight)


def train(docs: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The span classifier, from the votes on all candidates of all rows."""
    return _weights(stage(_found(docs, id_col, text_col)), sample)


def chosen(spans: list[Span], weights: np.ndarray) -> list[tuple[int, int, str]]:
    """Base spans and the added ones, in order; of overlapping added ones the likelier, then first, then longer stays."""
    out = [s[:3] for s in spans if s[3]]
    scored = sorted((-score, a, -b, kind) for a, b, kind, own, _, features in spans if not own and (score := float(weights[features].sum())) > 0)
    taken: list[tuple[int, int]] = []  # ascending and apart
    for _, a, b, kind in scored:
        i = bisect_left(taken, (a, 0))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= -b):
            taken.insert(i, (a, -b))
            out.append((a, -b, kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; the counts are of base spans."""
    found = stage(_found(docs, id_col, text_col))
    weights = _weights(found, sample)
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                spans = [tuple(s[f] for f in FIELDS) for s in spans]
                base = [s[:3] for s in spans if s[3]]
                rows.append((*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(chosen(spans, weights))))
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return found.mapInArrow(run, f"id {dict(found.dtypes)['id']}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Spans replaced by their kind; of overlapping ones the union is replaced, by the first one's kind."""
    out, last = [], 0
    for a, b, kind in spans:
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with its other columns as they are and personal data in the text replaced; null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                spans = candidates(text, base_spans(text)) if text else []
                out.append(redact_text(text, chosen(spans, weights)) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return small_batches(docs).mapInArrow(run, docs.schema)
