"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

Distinct words of a slice of texts lie in one flat numpy array of symbols. Each round finds, for every word, the
adjacent pair with the best rank (the leftmost of equals), merges those pairs all at once and compacts the array, until
no word has a pair left; words of very many characters are merged with a heap instead. Words are separate because no piece of the vocabulary holds a space mark after another
character; a vocabulary with such pieces is encoded as one word per text.

Defined cases: null and empty texts have no ids and decode to the empty text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Distinct words that a task remembers between slices before it starts anew: with ids, with digests only.
REMEMBERED = (100_000, 600_000)
#: Longer words than this are merged one by one with a heap: their rounds would be as many as their merges.
LONG_WORD = 2_000
#: Bytes of text that are encoded at a time.
SLICE = 1 << 20


@dataclass(frozen=True)
class Model:
    """Tables of one vocabulary. Symbols are piece ids; characters that only occur inside pieces get numbers past them."""

    pairs: np.ndarray  # left * width + right, sorted
    rank: np.ndarray  # of each pair's merged piece: smaller merges first
    merged: np.ndarray
    width: int
    chars: dict[str, int]
    surface: list[str | None]  # text of each id; None for bytes, see raw
    names: list[str]  # each id in decimal
    raw: dict[int, int]  # id -> byte
    byte_id: np.ndarray
    marked: frozenset[int]
    pieces: int
    by_word: bool
    prefix: bool

    @staticmethod
    def load(path: str) -> Model:
        """Read the vocabulary; files that need character normalisation are refused."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("a  b", "ﬁ 　", "Ǻ"):
            if sp.decode(sp.encode(probe)) != probe:
                raise ValueError("only vocabularies with identity normalisation are supported")
        n = sp.vocab_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        at = {text[i]: i for i in plain}
        chars = {c: at[c] for c in at if len(c) == 1}
        for piece in at:
            for c in piece:
                chars.setdefault(c, n + len(chars))
        width = max(n, *chars.values()) + 1
        symbol = at | chars
        order = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in plain}))}
        found = [(symbol[p[:k]] * width + symbol[p[k:]], order[-sp.get_score(i)], i) for p, i in at.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        found.sort()
        table = np.array(found, np.int64).reshape(-1, 3)
        raw = {i: int(text[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        byte_id = np.full(256, sp.unk_id(), np.int32)
        for i, b in raw.items():
            byte_id[b] = i
        surface = [None if i in raw else "" if sp.is_control(i) else " \u2047 " if sp.is_unknown(i) else text[i].replace(SPACE, " ") for i in range(n)]
        return Model(
            table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32), width, chars, surface, list(map(str, range(n))), raw, byte_id, frozenset(i for i in plain if text[i][0] == SPACE), n,
            not any(SPACE in p.lstrip(SPACE) for p in at), bool(sp.encode("a")) and sp.id_to_piece(sp.encode("a")[0]).startswith(SPACE),
        )

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = (" " if self.prefix else "") + text.replace(SPACE, " ")
        return re.findall(" *[^ ]+| +", text) if self.by_word else [text]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.width + right
        known = (left >= 0) & (right >= 0)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = known & (self.pairs[at] == key) if len(self.pairs) else np.zeros(len(key), bool)
        return np.where(hit, self.rank[at], NONE), np.where(hit, self.merged[at], -1)

    def _encode_long(self, word: str) -> list[int]:
        """Ids of one word by merging the best pair again and again, in time of n log n."""
        text = word.replace(" ", SPACE)
        symbol = [self.chars.get(c, -1) for c in text]
        after, before = [*range(1, len(text)), -1], [-1, *range(len(text) - 1)]
        alive = [True] * len(text)
        rank, into = (x.tolist() for x in self._ranks(np.array(symbol[:-1], np.int32), np.array(symbol[1:], np.int32)))
        heap = [(r, i, symbol[i], symbol[i + 1], m) for i, (r, m) in enumerate(zip(rank, into, strict=True)) if r < NONE]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i], alive[j], after[i] = merged, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and symbol[a] >= 0 and symbol[b] >= 0:
                    key = symbol[a] * self.width + symbol[b]
                    at = bisect_left(self.pairs, key)
                    if at < len(self.pairs) and self.pairs[at] == key:
                        heapq.heappush(heap, (int(self.rank[at]), a, symbol[a], symbol[b], int(self.merged[at])))
        out: list[int] = []
        for i, s in enumerate(symbol):
            if alive[i]:
                out.extend([s] if 0 <= s < self.pieces else self.byte_id[list(text[i].encode())].tolist())
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (a space stands for the space mark)."""
        if any(len(w) > LONG_WORD for w in words):
            short = iter(self.encode_words([w for w in words if len(w) <= LONG_WORD]))
            return [self._encode_long(w) if len(w) > LONG_WORD else next(short) for w in words]
        if not words:
            return []
        length = np.fromiter(map(len, words), np.int64, len(words))
        flat = "".join(words).replace(" ", SPACE)
        point = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        seen = np.zeros(0x110000, bool)
        seen[point] = True
        known = np.full(0x110000, -1, np.int32)
        for c in np.flatnonzero(seen).tolist():
            known[c] = self.chars.get(chr(c), -1)
        symbol, word = known[point], np.repeat(np.arange(len(words)), length)
        place = np.arange(len(symbol))  # of each symbol's first character
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, into = np.full(len(symbol), NONE, np.int32), np.full(len(symbol), -1, np.int32)  # of each symbol with the next
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same], into[same] = self._ranks(symbol[same], symbol[same + 1])
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            if not live.all():  # finished words leave
                sizes = np.diff(np.r_[starts, len(symbol)])
                stay = np.repeat(live, sizes)
                done.append((symbol[~stay], word[~stay], place[~stay]))
                symbol, word, place, rank, into = (x[stay] for x in (symbol, word, place, rank, into))
                if not len(symbol):
                    break
                best, sizes = best[live], sizes[live]
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
            else:
                sizes = np.diff(np.r_[starts, len(symbol)])
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            first = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]  # the leftmost of each word
            symbol[first] = into[first]
            keep = np.ones(len(symbol), bool)
            keep[first + 1] = False
            moved = np.cumsum(keep)[first] - 1
            symbol, word, place, rank, into = (x[keep] for x in (symbol, word, place, rank, into))
            touched = np.concatenate((moved, np.maximum(moved - 1, 0)))
            last = touched + 1 >= len(symbol)
            inner = touched[~last]
            inner = inner[word[inner] == word[inner + 1]]
            rank[touched], into[touched] = NONE, -1
            rank[inner], into[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        symbol, word, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        symbol, word, place = symbol[order], word[order], place[order]
        bounds = np.searchsorted(word, np.arange(len(words) + 1)).tolist()
        ids = symbol.tolist()
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        strange = (symbol < 0) | (symbol >= self.pieces)
        for i in np.unique(word[strange]).tolist():  # characters without a piece become their bytes
            a, b = bounds[i], bounds[i + 1]
            out[i] = [x for s, p in zip(ids[a:b], place[a:b].tolist(), strict=True) for x in ([s] if 0 <= s < self.pieces else self.byte_id[list(flat[p].encode())].tolist())]
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        each = [self.words(x or "") for x in texts]
        distinct = list(dict.fromkeys(w for ws in each for w in ws))
        ids = dict(zip(distinct, self.encode_words(distinct), strict=True))
        return [[i for w in ws for i in ids[w]] for ws in each]

    def joined(self, ids: list[int]) -> str:
        """The pieces' text, the first space mark included."""
        try:
            return "".join([self.surface[i] for i in ids])  # fails on the ids of bytes, which have no text of their own
        except TypeError:
            pass
        out: list[str] = []
        pending = bytearray()
        for i in ids:
            if (b := self.raw.get(i)) is not None:
                pending.append(b)
                continue
            if pending:
                out.append(_loose(bytes(pending)))
                pending.clear()
            out.append(self.surface[i])
        if pending:
            out.append(_loose(bytes(pending)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; a space mark that the first visible piece begins with is dropped."""
        text = self.joined(ids)
        first = next((i for i in ids if i in self.raw or self.surface[i]), None)
        marked = first is not None and first not in self.raw and first in self.marked
        return text[1:] if self.prefix and marked else text


def _loose(data: bytes) -> str:
    """Decode; each byte that isn't part of a whole character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in range(1, 5):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def encode(docs: DataFrame, model: Model, decode: bool = True, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) for every row, or with ``digest`` (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of: dict[str, str] = {}
        ids_of: dict[str, bytes | str] = {}
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for a, b in slices([max(256, n) for n in sizes], SLICE):  # a result for each slice, so that memory is bounded
                each = [model.words(x or "") for x in texts.slice(a, b - a).to_pylist()]
                if len(ids_of) > REMEMBERED[digest]:
                    text_of.clear()
                    ids_of.clear()
                fresh = [w for w in {w for ws in each for w in ws} if w not in ids_of]
                for w, ids in zip(fresh, model.encode_words(fresh), strict=True):
                    ids_of[w] = ",".join([model.names[i] for i in ids]) if digest else np.array(ids, np.int32).tobytes()
                    text = model.joined(ids) if decode else ""
                    text_of[w] = w if text == w else text
                decoded = ["".join([text_of[w] for w in ws])[1 if model.prefix else 0 :] for ws in each]
                columns = [batch.column(0).slice(a, b - a)]
                if digest:
                    joined = [",".join([ids_of[w] for w in ws]) for ws in each]
                    columns += [pa.array([x.count(",") + 1 if x else 0 for x in joined], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
                else:
                    parts = [b"".join([ids_of[w] for w in ws]) for ws in each]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in parts)]), pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
                    columns += [lists, pa.array(decoded if decode else [None] * len(each), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *(("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))])

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"))
