"""Chat formatting by token-level assembly.

Each turn's text is encoded by itself as ordinary text and the template's control tokens, which
have reserved ids above the vocabulary, are spliced around it. So no text can make a control token.
In the printed form a control string inside a text gets a backslash after its first character
(one more if it has some already), so it is told from the template's own and comes back whole.

Template: a user turn is [INST] text [/INST], an assistant turn text </s>, a turn of any other role
<|turn|> role <|text|> text <|end|>; a conversation starts with <s>. The loss mask covers each
assistant turn's text and its </s>; it is the running sum of +1 where such a stretch begins and -1
where it ends.

Edge cases: null texts and roles count as empty; a null conv_id is a conversation of its own; turns
that share conv_id and turn follow each other by role, then text; nulls in turn come first; empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.common import text_slices

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>")
BOS, EOS, USER, USER_END, TURN, TEXT, END = range(len(CONTROLS))
RESERVED = 50_257  # the vocabulary's ids are all below
_HELD = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = re.compile(_HELD)
_UNESCAPE = re.compile(_HELD.replace(r"\\*", r"\\+"))
_SPLIT = re.compile("(" + "|".join(map(re.escape, CONTROLS)) + ")")

_encoders: dict[str, object] = {}


def escape(text: str) -> str:
    """text without any control string."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def encoder(path: str | None = None):
    """The byte-level BPE at path (a .tiktoken file); by default byte_bpe_50k of the installed public tokenizers."""
    key = path or ""
    if key not in _encoders:
        import tiktoken
        import public_tokenizers as public

        lines = open(path or public.path("byte_bpe_50k.tiktoken"), "rb").read().splitlines()  # noqa: SIM115
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
        _encoders[key] = tiktoken.Encoding("ordinary", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _segment(role: str, text: str, encode) -> tuple[list[int], list[int]]:
    """ids of a turn, and the steps of its loss mask: +1 where the loss begins, -1 after it ends."""
    body = encode(escape(text))
    if role == "user":
        ids = [RESERVED + USER, *body, RESERVED + USER_END]
    elif role == "assistant":
        ids = [*body, RESERVED + EOS]
        return ids, [1] + [0] * (len(ids) - 1) + [-1]
    else:
        ids = [RESERVED + TURN, *encode(escape(role)), RESERVED + TEXT, *body, RESERVED + END]
    return ids, [0] * (len(ids) + 1)


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, masks = [], []
                for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own, steps = _segment(role or "", text or "", encode)
                    ids.append(np.array(own, np.int32))
                    masks.append(np.cumsum(steps)[: len(own)].astype(np.int8))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("role"), part.column("text"), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8()))],
                    names=["conv_id", "turn", "role", "text", "ids", "loss"],
                )

    return run


def format_turns(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, ids, loss: one segment a turn, encoded where its row lies.

    The first turn's <s> is added by assemble() or read_back(), which see the order.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.mapInArrow(_encode(tokenizer), "conv_id long, turn long, role string, text string, ids array<int>, loss array<byte>")


def placed(segments: DataFrame) -> DataFrame:
    """segments with `start`, the position of their first id in their conversation (<s> is at 0), a prefix sum of lengths."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start", F.coalesce(F.sum(F.size("ids")).over(order), F.lit(0)) + 1)


def assemble(segments: DataFrame) -> DataFrame:
    """conv_id, ids, loss: one row a conversation, for a trainer; each must fit in one row."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "ids", "loss")))
    whole = segments.groupBy("conv_id").agg(turns.alias("turns"))
    ids = F.concat(F.array(F.lit(RESERVED + BOS)), F.flatten(F.transform("turns", lambda t: t["ids"])))
    loss = F.concat(F.array(F.lit(0).cast("byte")), F.flatten(F.transform("turns", lambda t: t["loss"])))
    return whole.select("conv_id", ids.alias("ids"), loss.alias("loss"))


def parse(printed: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a printed conversation or of a part that begins and ends with a turn."""
    parts = _SPLIT.split(printed.removeprefix(CONTROLS[BOS]))
    turns, i = [], 0
    while i < len(parts) - 1:
        body, mark = parts[i], CONTROLS.index(parts[i + 1])
        if mark == USER:
            turns.append(("user", unescape(parts[i + 2])))
            i += 4
        elif mark == EOS:
            turns.append(("assistant", unescape(body)))
            i += 2
        else:
            turns.append((unescape(parts[i + 2]), unescape(parts[i + 4])))
            i += 6
    return turns


def printed(ids: np.ndarray, decode) -> str:
    """The text of ids, control tokens included."""
    cuts = np.flatnonzero(ids >= RESERVED)
    out, last = [], 0
    for c in cuts:
        out += [decode(ids[last:c].tolist()), CONTROLS[ids[c] - RESERVED]]
        last = c + 1
    return "".join([*out, decode(ids[last:].tolist())])


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, len(CONTROLS[BOS])
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, loss: np.ndarray, decode) -> None:
        text = printed(ids, decode)
        self.chars += len(text)
        for role, body in parse(text):
            self.turns += 1
            self.all.update(f"{role}\n{body}\n".encode())
        under = unescape(decode(ids[(loss > 0) & (ids < RESERVED)].tolist()))
        self.loss_chars += len(under)
        self.loss.update(under.encode())

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode
        now: _Digest | None = None
        for batch in batches:
            rows = []
            ids, loss = batch.column("ids"), batch.column("loss")
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = _Digest(conv)
                now.add(ids[i].values.to_numpy(), loss[i].values.to_numpy(), decode)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r, strict=True)) for r in rows], schema=_DIGESTS)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, now.row(), strict=True))], schema=_DIGESTS)

    return run


def read_back(segments: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of each conversation, from the token ids and masks alone.

    Segments of a conversation stream past in order, so that even a conversation of a third of all
    turns needs no more memory than its running digests.
    """
    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "ids", "loss")
    return ordered.mapInArrow(_read(tokenizer), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
