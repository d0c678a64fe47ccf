"""Embedding near-dedup and top-k search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.llm.embedding_dedup import near_duplicate_vectors
from galeframe.llm.topk_search import ImpactIndex, top_k


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def clusters(seed, n=300, dim=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, dim))
    x = centers[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * 0.35
    x[50:60] = x[50]
    return x.astype(np.float32)


def brute(x, threshold):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = u @ u.T >= threshold
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(x))])
        if (new == label).all():
            return link.sum(axis=1), label
        label = new


@pytest.mark.parametrize("block_rows", [8192, 64])
def test_links_and_components(spark, block_rows):
    x = clusters(1)
    want_links, want = brute(x, 0.9)
    assert 50 < (want_links > 0).sum()
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = {r.vec_id: r for r in near_duplicate_vectors(df, 0.9, block_rows=block_rows).collect()}
    assert [got[i].n_links for i in range(len(x))] == want_links.tolist()
    assert [got[i].component_id for i in range(len(x))] == want.tolist()
    assert all(got[i].kept == (want[i] == i) for i in range(len(x)))


def test_near_threshold_pairs_are_settled_exactly(spark):
    angle = np.arccos(0.9)
    pairs = [(0, [1.0, 0.0]), (1, [float(np.cos(angle - 1e-9)), float(np.sin(angle - 1e-9))]), (2, [float(np.cos(-angle - 1e-7)), float(np.sin(-angle - 1e-7))])]
    got = {r.vec_id: r.n_links for r in near_duplicate_vectors(vectors(spark, [(i, v, 0) for i, v in pairs], "double"), 0.9).collect()}
    assert got == {0: 1, 1: 1, 2: 0}


def test_long_vectors_and_many_pairs_at_the_threshold(spark):
    """Over 1024 components, and a crowd of pairs that the codes cannot settle."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 2500))
    x[30:] = x[:30] + rng.normal(size=(30, 2500)) * np.linspace(0.3, 0.7, 30)[:, None]
    want_links, want = brute(x, 0.9)
    got = {r.vec_id: r for r in near_duplicate_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], "double"), 0.9).collect()}
    assert 0 < want_links.sum() < 60 and [got[i].n_links for i in range(60)] == want_links.tolist() and [got[i].component_id for i in range(60)] == want.tolist()
    angle = np.arccos(0.9)
    y = np.array([[np.cos(k * angle + e), np.sin(k * angle + e)] for k in range(4) for e in rng.normal(size=40) * 1e-6])
    want_links, want = brute(y, 0.9)
    got = {r.vec_id: r for r in near_duplicate_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(y)], "double"), 0.9).collect()}
    assert [got[i].n_links for i in range(160)] == want_links.tolist() and [got[i].component_id for i in range(160)] == want.tolist()


def test_unusable_vectors_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [1.0], 1), (9, [2.0, 0.0], 1), (10, [], 1), (None, [1.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(vectors(spark, rows), 0.9).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[9] == (2, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 10):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)


def test_empty_and_clashing_columns(spark):
    assert near_duplicate_vectors(vectors(spark, []), 0.9).collect() == []
    df = vectors(spark, [(1, [1.0, 2.0], 0)]).withColumns({"rep": F.lit(1), "key": F.lit("x"), "component": F.lit(2), "vector": F.lit(3)})
    assert near_duplicate_vectors(df).count() == 1
    assert top_k(df.limit(0), F.col("vec_id") == 1).collect() == []


@pytest.mark.parametrize(("block_rows", "query_rows"), [(65_536, 4096), (70, 5)])
def test_top_k_equals_brute_force(spark, block_rows, query_rows):
    x = clusters(2, 250)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = [tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0, block_rows=block_rows, query_rows=query_rows).collect()]
    want = []
    for i in range(0, 250, 10):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(250), -s)) if j != i][:5]
        want += [(i, r, j, int(s[j])) for r, j in enumerate(order, 1)]
    assert sorted(got) == want


def test_index_stops_only_on_proof():
    rng = np.random.default_rng(3)
    values = rng.integers(-200, 200, (2000, 24))
    ids = np.arange(2000)
    index = ImpactIndex(ids, values, step=16)
    for i in range(40):
        rows, score = index.search(i, values[i], 7)
        s = values @ values[i]
        want = [j for j in np.lexsort((ids, -s)) if j != i][:7]
        assert rows.tolist() == want and score.tolist() == s[want].tolist()


def test_top_k_ties_few_rows_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (5, None, 0), (6, [None, 1.0], 0), (7, [float("nan"), 1.0], 0), (8, [1.0], 0), (None, [1.0, 1.0], 0), (9, [0.0, 0.0], 0)]
    got = [tuple(r) for r in top_k(vectors(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 65536), (0, 2, 3, 65536), (0, 3, 9, 0)]


@pytest.mark.parametrize("block_rows", [16_384, 3])
def test_top_k_keeps_large_finite_vectors(spark, block_rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 4))
    x[:, 0] = np.abs(x[:, 0])
    x[[0, 7, 40]] *= 2e6  # beyond 2**28 after scaling
    x[51] = [-1e13, 0.0, 0.0, 0.0]  # below the longs with 0 and 40, but never among the best
    q = [[int(np.floor(256 * v)) for v in row] for row in x]
    got = [tuple(r) for r in top_k(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)], "double"), F.col("vec_id") % 10 == 0, block_rows=block_rows).collect()]
    want = []
    for i in range(0, 120, 10):
        s = [sum(a * b for a, b in zip(q[i], c, strict=True)) for c in q]
        order = [j for j in sorted(range(120), key=lambda j: (-s[j], j)) if j != i][:5]
        want += [(i, r, j, s[j]) for r, j in enumerate(order, 1)]
    assert {0, 7, 40} <= {j for _, _, j, _ in want}
    assert sorted(got) == want


def test_top_k_raises_where_a_score_does_not_fit(spark):
    for a, b in ((1e12, 1e12), (1e12, -1e12)):
        with pytest.raises(Exception, match="does not fit a long"):
            top_k(vectors(spark, [(0, [a], 0), (1, [b], 0)], "double"), F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("large", [1, 2**20])
def test_queries_share_passes_over_postings(large):
    rng = np.random.default_rng(6)
    values = rng.integers(-150, 150, (3000, 24)).astype(np.int64) * large
    ids = rng.permutation(3000) * 2
    index = ImpactIndex(ids, values, step=16 * large)
    read, plain = [], index.segments

    class Counted(list):
        def __getitem__(self, t):
            read.append(t)
            return plain[t]

    index.segments = Counted(plain)
    found = index.search_all(ids[:60], values[:60], 5)
    assert len(read) <= len(plain)  # one pass over the postings for all queries together
    for i, (rows, score) in enumerate(found):
        want = sorted(((-int(x), int(j)) for x, j in zip(values @ values[i], ids, strict=True) if j != ids[i]))[:5]
        assert [(-int(s), int(ids[r])) for r, s in zip(rows, score, strict=True)] == want
