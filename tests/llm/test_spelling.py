"""Spelling variants against brute force over all pairs of words; odd texts."""

import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from galeframe.llm import spelling
from galeframe.llm.common import scratch
from galeframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def edits(word, letters):
    """All words one edit away."""
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return out - {word}


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def apart_by_one(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    lead = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) == len(a) + 1 and a[lead:] == b[lead + 1 :]


def brute(counts):
    letters = {c for w in counts for c in w}
    if len(counts) < 100:  # few words, maybe very long ones
        near = {w: [v for v in counts if apart_by_one(v, w)] for w in counts}
    else:
        near = {w: [v for v in edits(w, letters) if v in counts] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def rows_of(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"/root/testdata/{sf}/documents.parquet").to_pylist()]
    want = brute(brute_words(docs))
    assert any(r[1] for r in want) and rows_of(QUERIES["op12_spelling"](spark, f"/root/testdata/{sf}")) == want


@pytest.mark.parametrize("block", [4096, 3])
def test_any_words_in_blocks_of_any_size(spark, monkeypatch, block):
    """Crowded words over few letters, letters beyond Latin-1 that share bits, chains of forms, ties."""
    monkeypatch.setattr(spelling, "_BLOCK", block)
    rng = random.Random(block)
    letters = "ab" + chr(ord("a") + 90) + "éÿ中" + chr(0x1F600)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): rng.choice([1, 2, 2, 4, 8, 16]) for _ in range(300)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    with scratch(spark) as store:
        got = {(r.word, r.n_near, r.best_n, r.best) for r in spelling.near_words(df, store).collect()}
    want = set()
    for w in words:
        near = [v for v in edits(w, set(letters)) if v in words]
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            want.add((w, len(near), words[best], best))
    assert got == want


def test_forms_lead_to_their_root(spark):
    pairs = [(f"w{k}", f"w{k + 1}") for k in range(40)] + [("w40", None), ("alone", None), ("x", "w3")]
    df = spark.createDataFrame(pairs, "word string, form string")
    with scratch(spark) as store:
        got = {r.word: r.root for r in spelling.rooted(df, store).collect()}
    assert got == {w: "alone" if w == "alone" else "w40" for w, _ in pairs}


def test_odd_texts(spark):
    long = "Zebra zebrA ÉCLAIR éclair " * 60_000 + "q" * 100_000 + " " + "q" * 99_999
    rows = [(1, None), (2, ""), (2, ""), (None, "apple apples Apple"), (3, "apple apple apples apples"), (4, long), (5, "q" * 100_000), (6, ("q" * 100_000 + " " + "q" * 99_999 + " ") * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("a.b", F.lit(1)).withColumn("N", F.create_map(F.lit(1), F.lit(2)))
    assert rows_of(spelling.variants(docs)) == brute(brute_words(rows))
    assert spelling.variants(docs.limit(0)).count() == 0 and spelling.variants(docs.where("doc_id < 3")).count() == 0
