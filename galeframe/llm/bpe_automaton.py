"""Byte-level BPE by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton whose arcs carry tokens and that
accepts exactly the token sequences BPE can give. It starts as one state with a loop for every byte.
The gadget of a merge (u, v) -> c takes the state that u leads to, in a copy of its own if other
tokens lead there too, removes its arc v, and adds an arc c beside every arc u, leading where v led.
Copies hold only what was removed from them: an arc c of a state stands or falls with what the
state had when c was added, so rows of the transition table are worked out when first asked for and
kept. As every text has one accepted spelling, and so has every prefix of one, a pre-split word is
encoded by following arcs that spell it, the longest first, and each place in it is reached at most
once. Decoding emits the bytes that label each token's arc.

Tokens that the file lists as added are cut out of the text first, as the library does; then the
file's pattern splits the rest into words. Unicode's classes differ between releases from U+0530
on, so texts with such characters are split by the library that reads the file; the words are then
encoded in the same way.

Edge cases: null and empty texts have no tokens; unknown ids and ids of no token raise; ids whose
bytes are no UTF-8 decode with U+FFFD. A very long text is taken a stretch of words at a time, its
ids are held whole. Two merges that give one token, or settings of the file other than plain byte-level
BPE, raise ValueError. Columns other than the text are passed through by encode() and decode() under
any names; one named ids (decoded) in any case of letters is replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import added, text_slices, with_made

_WORDS = 1 << 16  # words of a long text taken at once
_WHOLE = 1 << 20  # characters of a text whose words are taken together
_MOST = 1 << 19  # words whose ids are remembered
_AGREED = "԰"  # below it all releases of Unicode class characters alike
_encoders: dict[str, "Encoder"] = {}


class Automaton:
    """The automaton of a list of merges over n_base single symbols, numbered 0 to n_base - 1.

    merges: (u, v, c) in order of priority, each c given once. State 0 is the start.
    """

    def __init__(self, n_base: int, merges: list[tuple[int, int, int]]):
        n = max([n_base - 1, *(c for *_, c in merges)]) + 1
        self.n = n
        self.left, self.born = [-1] * n, [-1] * n
        self.target: list[int | None] = [0] * n_base + [None] * (n - n_base)  # where a token's arcs lead
        self.parent, self.copied = [-1], [0]  # the state that a state was copied from, and when
        self.removed: list[dict[int, int]] = [{}]  # for each state: token -> merge that removed its arc
        leading = [n_base + 1]  # tokens that lead to a state; the start counts as one
        for k, (u, v, c) in enumerate(merges):
            if self.target[c] is not None:
                raise ValueError(f"token {c} is made twice")
            q, beyond = self.target[u], self.target[v]
            if q is None or beyond is None or not self.has(q, v, k):
                continue  # no text ever shows u before v
            if u == v or leading[q] > 1:
                leading[q] -= 1
                leading.append(1)
                self.parent.append(q)
                self.copied.append(k)
                self.removed.append({})
                self.target[u] = len(self.parent) - 1
            self.removed[self.target[u]][v] = k
            leading[beyond] += 1
            self.left[c], self.born[c], self.target[c] = u, k, beyond
        self.table: dict[int, int] = {}  # state * n + token -> next state, or -1 where there is no arc

    def _gone(self, state: int, token: int, at: int) -> bool:
        """Whether a merge before `at` removed the token's arc from the state, or from what it was copied from before the copy."""
        while state >= 0:
            k = self.removed[state].get(token)
            if k is not None and k < at:
                return True
            at, state = min(at, self.copied[state]), self.parent[state]
        return False

    def has(self, state: int, token: int, at: int) -> bool:
        """Whether the state has the token's arc when `at` merges are in."""
        while True:
            if self._gone(state, token, at):
                return False
            token, at = self.left[token], self.born[token] + 1
            if token < 0:
                return True

    def entry(self, state: int, token: int) -> int:
        """Work out an entry of the finished automaton's table."""
        if len(self.table) > 1 << 21:
            self.table.clear()
        to = self.target[token]
        to = self.table[state * self.n + token] = to if to is not None and self.has(state, token, 1 << 60) else -1
        return to


class Encoder:
    """Splitter, automaton and arc labels of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str | None = None):
        import public_tokenizers as public
        import regex
        from tokenizers import Tokenizer

        path = path or public.path("byte_bpe_50k.json")
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, before, added = held["model"], held["pre_tokenizer"] or {}, held["added_tokens"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain &= held["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not plain or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} is not plain byte-level BPE")
        self.library = Tokenizer.from_file(path).pre_tokenizer
        # How byte-level files write bytes (printable ones as themselves, the others from U+0100 on) and split text into words.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.pattern = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        letter = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.byte = {c: b for b, c in letter.items()}
        vocab = model["vocab"]
        # In the automaton bytes are 0 to 255, in order, and the merges' tokens follow in order of priority.
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        number = {letter[b]: b for b in range(256)}
        for u, v in pairs:
            if u + v in number:
                raise ValueError(f"{u + v} is made twice")
            number[u + v] = len(number)
        self.ids = np.array([vocab.get(name, -1) for name in number], np.int64)
        if (self.ids < 0).any():
            raise ValueError("a byte or a merged token has no id")
        self.automaton = Automaton(256, [(number[u], number[v], number[u + v]) for u, v in pairs])
        self.label = {int(i): bytes(self.byte[c] for c in name) for name, i in zip(number, self.ids, strict=True)}
        self.spelled = {self.label[int(i)]: k for k, i in enumerate(self.ids)}
        self.id_bytes = [int(i).to_bytes(4, "little") for i in self.ids]
        self.reach: dict[bytes, int] = {}  # length of the longest token that begins with three bytes
        for name in self.spelled:
            self.reach[name[:3]] = max(len(name), self.reach.get(name[:3], 2))
        for name, i in vocab.items():
            self.label.setdefault(i, bytes(self.byte[c] for c in name) if all(c in self.byte for c in name) else name.encode())
        for t in added:
            self.label[t["id"]] = bytes(self.byte[c] for c in t["content"]) if all(c in self.byte for c in t["content"]) else t["content"].encode()
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._known: dict[str, bytes] = {}

    def word(self, raw: bytes) -> bytes:
        """Ids along the automaton's one path that spells a word."""
        table, entry, n = self.automaton.table, self.automaton.entry, self.automaton.n
        spelled, reach, size = self.spelled, self.reach, len(raw)
        path: list[tuple[int, int, int, bytes]] = []  # place, state and length of each token, and its id
        at, state, long = 0, 0, min(reach.get(raw[:3], 2), size)
        while at < size:
            while long:
                token = spelled.get(raw[at : at + long])
                if token is not None:
                    to = table.get(state * n + token)
                    if to is None:
                        to = entry(state, token)
                    if to >= 0:
                        break
                long -= 1
            if long:
                path.append((at, state, long, self.id_bytes[token]))
                at, state = at + long, to
                long = min(reach.get(raw[at : at + 3], 2), size - at)
            else:  # no arc goes on from here: the last token was too long
                at, state, long, _ = path.pop()
                long -= 1
        return b"".join([p[3] for p in path])

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in lists of bounded length."""
        if not (text.isascii() or max(text, default="") < _AGREED):
            yield [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        elif len(text) <= _WHOLE:
            yield self.pattern.findall(text)
        else:
            words = (m[0] for m in self.pattern.finditer(text))
            while some := list(islice(words, _WORDS)):
                yield some

    def _stretch(self, words: list[str]) -> bytes:
        known = self._known
        fresh = set(words).difference(known)
        if len(known) + len(fresh) > _MOST:
            known.clear()
            fresh = set(words)
        for w in fresh:
            known[w] = self.word(w.encode())
        return b"".join([known[w] for w in words])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out, at = [], 0
        for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
            out += [self._stretch(w) for w in self._words(text[at : m.start() if m else len(text)])]
            if m:
                out.append(self.added[m[0]])
                at = m.end()
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text that ids spell by their arcs' labels."""
        label = self.label
        return b"".join([label[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encoder(path: str | None = None) -> Encoder:
    """The encoder of the file at path, compiled once a process; by default byte_bpe_50k of the installed public tokenizers."""
    if (path or "") not in _encoders:
        _encoders[path or ""] = Encoder(path)
    return _encoders[path or ""]


def _ids(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in text_slices(batch, "read"):
                held = [np.frombuffer(own.encode(t or ""), "<u4") for t in part.column("read").to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
                yield added(part, pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(held).astype(np.int32))))

    return run


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """docs with ids array<int>, the tokens of the whole text by the file at tokenizer."""
    return with_made(docs, text, "ids", "array<int>", _ids(tokenizer))


def _texts(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts = [own.decode(np.array(x or (), np.int64)) for x in batch.column("read").to_pylist()]
            yield added(batch, pa.array(texts, pa.string()))

    return run


def decode(encoded: DataFrame, tokenizer: str | None = None, ids: str = "ids") -> DataFrame:
    """encoded with decoded, the text of its ids; null ids give an empty text."""
    return with_made(encoded, ids, "decoded", "string", _texts(tokenizer))


def _digests(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = [own.encode(t or "") for t in part.column("text").to_pylist()]
                texts = [own.decode(np.frombuffer(x, "<u4")) for x in ids]
                columns = [
                    part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256 (of ids as little-endian unsigned 32-bit integers), decoded_sha256 (of UTF-8)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_digests(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
