"""SentencePiece encoding and decoding over a suffix array of the batch.

The texts of a batch are normalised as the model asks (a space mark for each space, one before the
text) and cut where no piece can span, and the distinct cuts are laid end to end. A suffix array of
this text is searched for every piece of the vocabulary at once; each range of suffixes that a
piece begins gives its occurrences, the edges. The edges are sorted by position (a row of the edge
table a position, a column a length) and relaxed: in every cut the neighbours whose joined edge has
the best score, the leftmost of equals, are joined, until no edge joins neighbours. This is the
byte-pair rule of SentencePiece models of type BPE, so the ids equal the library's. Characters
without a piece become their UTF-8 bytes' pieces. Only the vocabulary is read from the model file.

Edge cases: null and empty texts have no ids; space marks in a text come back as spaces, as with
the library; very long cuts (no space for thousands of characters) use a heap over the same edges.
A text of any length is indexed a megabyte
of cuts at a time. Other columns, of any type and name, pass through encode(); one named ids is replaced.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import added, text_slices, with_made
from galeframe.llm.textkit import U, mix

SPACE = 0x2581
_NONE = np.iinfo(np.int32).max
_LONG = 48
_SLICE = 1 << 20  # characters of text indexed at once; the index takes about a hundred times as much
_codecs: dict[str, "Codec"] = {}


class Codec:
    """Vocabulary of a SentencePiece BPE model and the batch encoder and decoder."""

    def __init__(self, path: str | None = None):
        import public_tokenizers as public
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public.path("piece_bpe_32k.model"))
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.byte = np.full(256, self.unknown, np.int32)
        raw: list[bytes] = []
        plain: list[int] = []
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append("⁇ ".encode() if i == self.unknown else b"")
            else:
                raw.append(p.replace(chr(SPACE), " ").encode())
                plain.append(i)
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        score = np.array([model.get_score(i) for i in range(n)])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        multi = [i for i in plain if len(pieces[i]) > 1]
        self.single = {ord(pieces[i]): i for i in plain if len(pieces[i]) == 1}
        letters = sorted({c for i in multi for c in map(ord, pieces[i])})
        self.symbol = np.zeros(0x110000, np.uint16)  # 0: in no piece of two characters or more
        self.symbol[letters] = np.arange(1, len(letters) + 1)
        self.longest = max(len(pieces[i]) for i in multi)
        self.multi = np.array(multi, np.int32)
        self.held = np.int16 if n < 1 << 15 else np.int32
        self.length = np.array([len(pieces[i]) for i in multi])
        words = -(-self.longest // 4)
        spelled = np.zeros((len(multi), words * 4), np.uint16)
        self.joins = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for row, i in enumerate(multi):
            s = self.symbol[[ord(c) for c in pieces[i]]]
            spelled[row, : len(s)] = s
            self.joins[s[:-1], s[1:]] = True
        high = np.where(np.arange(words * 4)[None, :] < self.length[:, None], spelled, 0xFFFF).astype(np.uint16)
        self.low_keys, self.high_keys = self._keys(spelled), self._keys(high)
        self.char_id = np.full(0x110000, -1, np.int32)
        for c, i in self.single.items():
            self.char_id[c] = i

    @staticmethod
    def _keys(rows: np.ndarray) -> list[np.ndarray]:
        """Four symbols a key, the first most significant."""
        wide = rows.astype(U)
        return [(wide[:, k] << U(48)) | (wide[:, k + 1] << U(32)) | (wide[:, k + 2] << U(16)) | wide[:, k + 3] for k in range(0, rows.shape[1], 4)]

    def _suffixes(self, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The suffix array by the first `longest` symbols, and its sorted keys."""
        n, words = len(text), len(self.low_keys)
        padded = np.zeros(n + 4 * words + 3, U)
        padded[:n] = text
        four = (padded[:-3] << U(48)) | (padded[1:-2] << U(32)) | (padded[2:-1] << U(16)) | padded[3:]
        order, span = np.argsort(four), 4  # prefix doubling: ranks by 4, 8, 16 ... symbols
        rank = self._ranks(four, order)
        while span < 4 * words:
            pair = rank << U(32)
            pair[: len(rank) - span] |= rank[span:]
            order, span = np.argsort(pair), 2 * span
            rank = self._ranks(pair, order)
        order = order[order < n]
        return order, [four[np.minimum(order + 4 * k, len(four) - 1)] for k in range(words)]

    @staticmethod
    def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        held = keys[order]
        out = np.empty(len(keys), U)
        out[order] = np.cumsum(np.concatenate([[False], held[1:] != held[:-1]]), dtype=U) + U(1)
        return out

    @staticmethod
    def _bound(keys: list[np.ndarray], want: list[np.ndarray], after: bool) -> np.ndarray:
        """For each wanted key, the number of sorted keys below it (after: or equal)."""
        lo, hi = np.zeros(len(want[0]), np.int64), np.full(len(want[0]), len(keys[0]), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = np.minimum(mid, len(keys[0]) - 1)
            less, tie = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for k, w in zip(keys, want, strict=True):
                x = k[at]
                less |= tie & (x < w)
                tie &= x == w
            go = open_ & (less | tie if after else less)
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    def edges(self, text: np.ndarray) -> np.ndarray:
        """Edge table: row a position, column a length from 2 up; the piece's id, or -1."""
        table = np.full((len(text), self.longest - 1), -1, self.held)
        order, keys = self._suffixes(text)
        lo, hi = self._bound(keys, self.low_keys, False), self._bound(keys, self.high_keys, True)
        many = hi - lo
        which = np.repeat(np.arange(len(many)), many)
        start = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        table[order[np.arange(len(which)) + start], self.length[which] - 2] = self.multi[which]
        return table

    def _relax(self, table: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the final symbols of the cuts first..last, in order."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        size = last - first
        for c in np.flatnonzero(size > _LONG):
            done.append(self._heap(table, int(first[c]), int(last[c])))
        short = np.flatnonzero(size <= _LONG)
        n = size[short]
        cut = np.repeat(np.arange(len(short)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[short], n)
        end = start + 1
        while len(start):
            pair = np.full(len(start), _NONE, np.int32)
            inner = np.flatnonzero(cut[1:] == cut[:-1])
            long = end[inner + 1] - start[inner]
            fits = long <= self.longest
            inner, long = inner[fits], long[fits]
            found = table[start[inner], long - 2]
            some = found >= 0
            pair[inner[some]] = self.rank[found[some]]
            heads = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
            key = (pair.astype(np.int64) << 32) | np.arange(len(pair))
            best = np.minimum.reduceat(key, heads)
            at = best & 0xFFFFFFFF
            joined = (best >> 32) < _NONE
            counts = np.diff(np.append(heads, len(start)))
            active = np.repeat(joined, counts)
            if not joined.all():
                done.append((start[~active], end[~active]))
            at = at[joined]
            end[at] = end[at + 1]
            active[at + 1] = False
            start, end, cut = start[active], end[active], cut[active]
        starts = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        ends = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def _heap(self, table: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The same joins for one long cut."""
        n, longest = last - first, self.longest
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive, heap = [True] * n, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and end[j] - i <= longest:
                piece = table[first + i, end[j] - i - 2]
                if piece >= 0:
                    heapq.heappush(heap, (int(self.rank[piece]), i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, was, to = heapq.heappop(heap)
            if not alive[i] or end[i] != was or after[i] >= n or end[after[i]] != to:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, to, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        start = np.flatnonzero(alive)
        return start + first, np.array(end, np.int64)[start] + first

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, first position of each text and the end)."""
        points = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le"), np.uint32).copy()
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        points[points == 0x20] = SPACE
        symbols = self.symbol[points]
        fresh = np.ones(len(points) + 1, bool)
        fresh[1:-1] = ~self.joins[symbols[:-1], symbols[1:]]
        fresh[bounds] = True
        first = np.flatnonzero(fresh[:-1])
        size = np.diff(np.append(first, len(points)))
        counts, ids = [], []
        reach = np.cumsum(size)
        at = 0
        while at < len(first):  # a text of any length: no piece spans two cuts, so they are indexed some megabyte at a time
            to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _SLICE, "right")))
            lo, hi = int(first[at]), int(first[to - 1] + size[to - 1])
            ids_of, at_of, which = self._distinct(points[lo:hi], symbols[lo:hi], first[at:to] - lo, size[at:to])
            count = np.diff(at_of)[which]
            ids.append(ids_of[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at_of[which], count)])
            counts.append(count)
            at = to
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), ends[np.searchsorted(first, bounds)]

    def _distinct(self, points: np.ndarray, symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct cuts on end, their first positions, and each cut's number."""
        spell = mix(points.astype(U)) * np.cumprod(np.full(len(points), 0x5851F42D4C957F2D, U), dtype=U)
        sums = np.concatenate([[U(0)], np.cumsum(spell, dtype=U)])
        inverse = np.cumprod(np.full(len(points), pow(0x5851F42D4C957F2D, -1, 1 << 64), U), dtype=U)
        name = mix((sums[first + size] - sums[first]) * inverse[first] + size.astype(U))
        _, one, which = np.unique(name, return_index=True, return_inverse=True)
        own = first[one][which]
        step = np.arange(len(points)) - np.repeat(first, size)
        if not (size[one][which] == size).all() or not (points == points[np.repeat(own, size) + step]).all():
            one, which = np.arange(len(first)), np.arange(len(first))  # two spellings of one hash
        begin, n = first[one], size[one]
        where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        gap = np.arange(len(n))  # one 0 after each cut, so that no piece runs on
        text = np.zeros(n.sum() + len(n), np.uint16)
        place = np.arange(n.sum()) + np.repeat(gap, n)
        text[place] = symbols[where]
        letters = np.zeros(len(text), np.uint32)
        letters[place] = points[where]
        lo = np.cumsum(n) - n + gap
        table = self.edges(text)
        start, end = self._relax(table, lo, lo + n)
        long = end - start
        alone = long == 1
        ids = np.where(alone, self.char_id[letters[start]], table[start, np.maximum(long - 2, 0)])
        owner = np.searchsorted(lo, start, "right") - 1
        if len(odd := np.flatnonzero(ids < 0)):  # no piece: UTF-8 bytes
            spelt = [np.frombuffer(chr(int(letters[start[k]])).encode("utf-8", "surrogatepass"), np.uint8) for k in odd]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(s) for s in spelt]
            owner, base = np.repeat(owner, times), np.cumsum(times) - times
            ids = np.repeat(ids, times)
            ids[np.concatenate([base[k] + np.arange(len(s)) for k, s in zip(odd, spelt, strict=True)])] = self.byte[np.concatenate(spelt)]
        return ids.astype(np.int32), np.searchsorted(owner, np.arange(len(n) + 1)), which

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids, without the space that encoding puts before each."""
        n = (self.raw_at[1:] - self.raw_at[:-1])[ids]
        spelt = self.raw[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.raw_at[ids], n)].tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[at]
        texts = (spelt[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True))
        return [t[1:] if t[:1] == " " else t for t in texts]


def codec(path: str | None = None) -> Codec:
    """The codec of the model at path, made once a process; by default piece_bpe_32k of the installed public tokenizers."""
    if (path or "") not in _codecs:
        _codecs[path or ""] = Codec(path)
    return _codecs[path or ""]


def _with_ids(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in text_slices(batch, "read", _SLICE):
                ids, at = own.encode([t or "" for t in part.column("read").to_pylist()])
                yield added(part, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))

    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """docs with ids array<int>, the pieces of the whole text; a column of docs by this name, in any case of letters, is replaced."""
    return with_made(docs, "text", "ids", "array<int>", _with_ids(model))


def _with_text(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lists = batch.column("read").to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            ids = np.array([i for x in lists for i in x or ()], np.int32)
            yield added(batch, pa.array(own.decode(ids, at), pa.string()))

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded with decoded, the text of its ids, in place of a column by this name in any case of letters; null ids give an empty text."""
    return with_made(encoded, "ids", "decoded", "string", _with_text(model))


def _both(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in text_slices(batch, "text", _SLICE):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, at = own.encode(texts)
                back = own.decode(ids, at)
                same = [a == b or a.replace(chr(SPACE), " ") == b for a, b in zip(texts, back, strict=True)]
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                whole = [zlib.crc32(t.encode()) for t in back]
                columns = [part.column("doc_id"), np.diff(at), sums, [len(t) for t in back], whole, same]
                yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(c, pa.int64()) for c in columns[1:5]), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "decoded_chars", "decoded_crc32", "round_trip"])

    return run


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_ids, ids_crc32 (of little-endian 32-bit ids), decoded_chars, decoded_crc32, round_trip."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_both(model), "doc_id long, n_ids long, ids_crc32 long, decoded_chars long, decoded_crc32 long, round_trip boolean")
