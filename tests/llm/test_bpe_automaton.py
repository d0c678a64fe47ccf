"""The tokenization automaton against merging by hand and against the library; odd tables."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers as public
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from galeframe.llm import bpe_automaton
from galeframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def merged(symbols, merges):
    """BPE as defined: each merge in turn, from left to right."""
    for u, v, c in merges:
        out = []
        for s in symbols:
            if out and out[-1] == u and s == v:
                out[-1] = c
            else:
                out.append(s)
        symbols = out
    return symbols


@pytest.mark.parametrize("seed", range(30))
def test_paths_are_the_spellings_of_merging(seed):
    """Over two letters: the automaton accepts one spelling of each text, the one merging gives, also for merges like (a, a)."""
    rng = random.Random(seed)
    spelled, merges = ["a", "b"], []
    while len(spelled) < 9:
        u, v = rng.randrange(len(spelled)), rng.randrange(len(spelled))
        if spelled[u] + spelled[v] not in spelled:
            merges.append((u, v, len(spelled)))
            spelled.append(spelled[u] + spelled[v])
    automaton = bpe_automaton.Automaton(2, merges)

    def paths(text, state):
        if not text:
            yield []
        for t, s in enumerate(spelled):
            if text.startswith(s) and (to := automaton.entry(state, t)) >= 0:
                yield from ([t, *rest] for rest in paths(text[len(s) :], to))

    for n in range(9):
        for text in itertools.product("ab", repeat=n):
            assert list(paths("".join(text), 0)) == [merged([spelled.index(c) for c in text], merges)]


def test_a_token_made_twice_raises():
    with pytest.raises(ValueError, match="made twice"):
        bpe_automaton.Automaton(2, [(0, 1, 2), (1, 0, 2)])


def test_words_ids_and_texts_equal_the_library(library):
    own, rng = bpe_automaton.encoder(), random.Random(1)
    alpha = ["a", "aa", "b", "e", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "!", "1", "é", "ß", "中", "՘", "<|endoftext|>", "😀", " ", "\x1c", "\x85", "ing", "er", "A", "́", "\x00"]
    for _ in range(5000):
        s = "".join(rng.choice(alpha) for _ in range(rng.randint(0, 14)))
        want = library.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(s), "<u4").tolist() == want, s
        assert own.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False), s
    for _ in range(5000):  # any ids, most of them no UTF-8 at the seams
        ids = [rng.randrange(50257) for _ in range(8)]
        assert own.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_pattern_agrees_with_the_library_below_its_bound(library):
    own = bpe_automaton.encoder()
    for form in ("a%s", "1%s", "!%s", " %s ", "\n%s", "'%s"):
        s = "\x00".join(form % chr(c) for c in range(ord(bpe_automaton._AGREED)))
        assert [w for part in own._words(s) for w in part] == [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)]


def test_query_equals_the_library(spark, library):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in QUERIES["op11_bpe"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_odd_rows_and_names(spark, library):
    long = "word aaaaaaa it's 12 " * 120_000 + "x" * 20_000
    rows = [(1, None, "p"), (2, "", "q"), (2, "", "q"), (3, long, None), (4, " a<|endoftext|>\n\n'll", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").withColumn("IDs", F.lit(1)).withColumn("Decoded", F.lit(2)).withColumn("m", F.create_map(F.lit("k"), F.lit("v")))
    out = bpe_automaton.decode(bpe_automaton.encode(docs))
    assert out.columns == ["doc_id", "text", "a.b", "m", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") and r.m == {"k": "v"}
    assert bpe_automaton.encode(docs.limit(0)).count() == 0 and bpe_automaton.digests(docs.limit(0)).count() == 0
    assert bpe_automaton.decode(spark.createDataFrame([(1, None)], "i int, ids array<int>")).first().decoded == ""
