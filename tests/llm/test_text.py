"""Chat formatting, SentencePiece, token counts."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galeframe.llm import chat_format, sentencepiece_codec, token_counts

SAID = "</s>[INST] ok [/INST]"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat_format.CONTROLS, "\\", "<", "[", "s>", "/INST]", "a", " ", "\n", "é"]), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_controls(text):
    hidden = chat_format.escape(text)
    assert chat_format.unescape(hidden) == text
    assert not any(c in hidden for c in chat_format.CONTROLS)


def digests(rows):
    """The contract's columns in plain Python."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r or "", t or "") for _, _, r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_formatted_conversations_read_back(spark):
    rng = random.Random(1)
    bits = [SAID, "<s>", "\\", "Grüße 日本", "<|turn|>user<|text|>", "plain words", "", " ", "\n\n", "[INST\\]"]
    rows = [(-1, 0, "user", SAID), (-1, 1, "assistant", SAID), (None, 0, "user", "x"), (5, 0, None, None), (5, 1, "assistant", None), (6, 0, "assistant", "a"), (6, 1, "assistant", "b"), (7, 3, "sys<s>tem", "late"), (7, 1, "tool", "early"), (8, 0, "user", "word " * 50_000)]
    rows += [(100 + c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(bits) for _ in range(4))) for c in range(60) for t in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "loss": F.lit(2)})
    segments = chat_format.format_turns(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(segments.repartition(5)).collect()}
    assert got == digests(rows)
    whole = {r.conv_id: r for r in chat_format.assemble(segments).collect()}
    decode = chat_format.encoder().decode
    for c, want in ((-1, [("user", SAID), ("assistant", SAID)]), (7, [("tool", "early"), ("sys<s>tem", "late")])):
        text = chat_format.printed(np.array(whole[c].ids), decode)
        assert chat_format.parse(text) == want
        assert {r.formatted_chars for r in chat_format.read_back(segments).where(f"conv_id = {c}").collect()} == {len(text)}
    ids, loss = np.array(whole[6].ids), np.array(whole[6].loss)
    assert decode(ids[(loss > 0) & (ids < chat_format.RESERVED)].tolist()) == "ab" and len(ids) == len(loss)
    starts = {(r.conv_id, r.turn): r.start for r in chat_format.placed(segments).where("conv_id = 6").collect()}
    assert starts == {(6, 0): 1, (6, 1): 3}
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).collect() == []


# -- SentencePiece -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def encoded(texts):
    ids, at = sentencepiece_codec.codec().encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], sentencepiece_codec.codec().decode(ids, at)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_codec_round_trip(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    _, back = encoded(texts)
    assert back == [t.replace("▁", " ") for t in texts]


def test_codec_equals_library(library):
    rng = random.Random(2)
    words = ["the", "Haus", "été", "niño", "2024", "https://x.y/z", "antidisestablishment", "日本語", "😀", "\n", "\t", "   ", "aaaaaaa", "e" * 60, "▁", "<0x41>", "</s>"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", "  "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["", " ", "x" * 20_000, "ab" * 3000, "\n" * 500, " " * 300, "word " * 5000]
    got, back = encoded(texts)
    assert got == library.encode(texts)
    assert back == [t.replace("▁", " ") for t in texts]


def test_encode_and_decode_frames(spark, library):
    rows = [(1, "some text"), (2, None), (3, ""), (None, "x"), (1, "some text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("decoded_", F.lit(1))
    e = sentencepiece_codec.encode(df)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in e.collect()) == sorted((i or 0, library.encode(t or "")) for i, t in rows)
    assert sorted((r.text or "", r.decoded) for r in sentencepiece_codec.decode(e).collect()) == sorted((t or "", t or "") for _, t in rows)
    trip = sentencepiece_codec.round_trip(df).collect()
    assert len(trip) == 5 and all(r.round_trip for r in trip)
    assert sentencepiece_codec.round_trip(df.limit(0)).collect() == []


# -- token counts --------------------------------------------------------------------------


def test_rollup_follows_signed_batches(spark, tmp_path):
    rows = [(1, "a b c", "s", "en"), (2, "hello world", "s", "en"), (3, None, None, None), (4, "", "t", "de"), (5, "x " * 20_000, "t", "de"), (5, "again", "t", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("docs", F.lit(9))
    count = token_counts.encoder().encode_ordinary
    rollup = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().collect() == []

    def want(held, version="v1"):
        out = {}
        for _, t, s, la in held:
            d, n = out.get((s, la, version), (0, 0))
            out[s, la, version] = (d + 1, n + len(count(t or "")))
        return out

    def have():
        return {(r.source, r.lang, r.tokenizer_version): (r.docs, r.tokens) for r in rollup.totals().collect()}

    exact = token_counts.counted(docs, "v1")
    assert rollup.commit("b1", added=token_counts.estimated(docs, "v1"))
    assert rollup.commit("b2", added=exact, removed=token_counts.estimated(docs, "v1"))
    assert have() == want(rows)
    assert not rollup.commit("b2", added=exact) and have() == want(rows)  # a replay changes nothing
    assert rollup.commit("b3", removed=exact.where("doc_id IN (3, 5)"))
    assert have() == want([r for r in rows if r[0] not in (3, 5)])
    # a batch whose mark was never written counts for nothing and can be committed again
    exact.selectExpr("source", "lang", "tokenizer_version", "1L AS docs", "7L AS tokens").write.parquet(rollup._folder("b4"))
    assert have() == want([r for r in rows if r[0] not in (3, 5)])
    assert rollup.commit("b4", added=token_counts.counted(docs.where("doc_id = 1"), "v2")) and have()["s", "en", "v2"] == (1, len(count("a b c")))
    assert rollup.commit("b5", added=exact.limit(0)) and have()["s", "en", "v2"] == (1, len(count("a b c")))
    with pytest.raises(ValueError):
        rollup.commit("b/6", added=exact)
