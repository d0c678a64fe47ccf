"""Whitening against plain whole-number arithmetic in Python; odd vectors."""

import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from galeframe.llm import whitening
from galeframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(vectors):
    """n, S and the scatter of the distinct vectors on the grid, all exact; and each vector's place on it."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(d)]
    y = [[n * v[i] - sums[i] for i in range(d)] for v in fit]
    return x, n, sums, [[sum(r[i] * r[j] for r in y) for j in range(d)] for i in range(d)]


def check(rows, ids, vectors, components):
    x, n, sums, scatter = brute(vectors)
    v = np.array([[float(Fraction(c, n**3)) for c in line] for line in scatter])
    values = np.linalg.eigvalsh(v)[::-1]
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(by) == sorted(ids)
    w = np.zeros((len(ids), components))
    for k, i in enumerate(ids):
        own = sorted(by[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, components + 1))
        assert {(r.n, r.deviation) for r in own} == {(n, sum((n * a - s) ** 2 for a, s in zip(x[k], sums, strict=True)))}
        w[k] = [r.whitened for r in own]
        np.testing.assert_allclose([r.explained for r in own], values[:components] / v.trace(), rtol=1e-9)
    first = {p: k for k, p in enumerate(x)}
    fit = w[sorted(first.values())]
    cov = fit.T @ fit / n - np.outer(fit.mean(0), fit.mean(0))
    assert abs(fit.mean(0)).max() < 1e-9 and abs(cov - np.eye(components)).max() < 1e-9
    assert {r.identity_error for r in rows} and max(r.identity_error for r in rows) < 1e-9
    # projections: V times the component is the component times its eigenvalue
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(p, sums, strict=True)] for p in x])
    for k in range(components):
        c = np.linalg.lstsq(centred, w[:, k] * math.sqrt(values[k]), rcond=None)[0]
        assert abs(np.linalg.norm(c) - 1) < 1e-7 and np.abs(v @ c - values[k] * c).max() < 1e-7 * values[0]


def test_query_equals_whole_number_arithmetic(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    rows = QUERIES["op13_whitening"](spark, SF).collect()
    check(rows, [r["vec_id"] for r in table], [r["embedding"] for r in table], 16)


def test_residues_and_remainders():
    rng = np.random.default_rng(1)
    moduli = whitening.primes(1 << 100)
    assert moduli[:2] == [1048573, 1048571] and math.prod(moduli) > 1 << 100 >= math.prod(moduli[:-1])
    want = np.array([[int(a) * int(b) * s for a, b in zip(rng.integers(0, 1 << 45, 5), rng.integers(0, 1 << 45, 5), strict=True)] for s in (1, -1)], object)
    got = whitening.reconstructed({p: np.array([[v % p for v in line] for line in want], np.int64) for p in moduli})
    assert (got == want).all()


def test_any_size_of_entries(spark):
    """Entries far apart: more primes, Python's numbers where longs end, still exact."""
    rng = np.random.default_rng(2)
    vectors = [[float(c) for c in rng.normal(size=3) * (1e13, 1.0, 1e4)] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    models = whitening.fit(df)
    x, n, sums, scatter = brute(vectors)
    m = models[3]
    assert (m.n, m.sums) == (n, sums) and m.identity_error < 1e-9 and len(m.values) == 1  # the others lie below rounding of the first
    got = {r.vec_id: r.whitened.deviation for r in whitening.transform(df, models).collect()}
    for k, p in enumerate(x):
        want = sum((n * a - s) ** 2 for a, s in zip(p, sums, strict=True))
        assert got[k] == (want if want < 1 << 63 else None)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(3)
    good = [[float(c) for c in rng.normal(size=4)] for _ in range(30)]
    pairs = [[float(c) for c in rng.normal(size=2)] for _ in range(9)]
    odd = [None, [], [1.0, None, 2.0, 3.0], [nan, 0.0, 0.0, 0.0], [1.0, 2.0, inf, 0.0], [-inf, 0.0, 0.0, 0.0]]
    vectors = good + good[:7] + odd + pairs
    df = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = whitening.coordinates(df, whitening.fit(df)).collect()
    held = [(k, v) for k, v in enumerate(vectors) if v in good]
    check([r for r in rows if r.vec_id < 37], [k for k, _ in held], [v for _, v in held], 4)
    check([r for r in rows if r.vec_id >= 43], list(range(43, 52)), pairs, 2)
    assert len(rows) == 37 * 4 + 9 * 2
    named = df.withColumnsRenamed({"embedding": "Embedding"}).withColumn("a.b", F.lit(1)).withColumn("Whitened", F.lit(2)).withColumn("x", F.create_map(F.lit(1), F.lit(2))).withColumn("w", F.lit("w"))
    out = whitening.transform(named, whitening.fit(named))
    assert out.columns == ["vec_id", "Embedding", "a.b", "x", "w", "whitened"]
    got = {r.vec_id: r for r in out.collect()}
    assert len(got) == len(vectors) and all(got[37 + k].whitened is None for k in (0, 2, 3, 4, 5)) and got[38].whitened.asDict() == {"deviation": None, "values": []} or got[38].whitened is None
    empty = df.limit(0)
    assert whitening.fit(empty) == {} and whitening.coordinates(empty, {}).count() == 0


def test_equal_vectors_have_no_components(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    models = whitening.fit(df)
    assert (models[2].n, len(models[2].values)) == (1, 0)
    assert whitening.coordinates(df, models).count() == 0
    assert [r.whitened.deviation for r in whitening.transform(df, models).collect()] == [0, 0]


@pytest.mark.parametrize("rows", [1, 5])
def test_fewer_vectors_than_dimensions(spark, rows):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, [float(c) for c in rng.normal(size=8) * 3]) for k in range(rows)], "vec_id long, embedding array<double>")
    models = whitening.fit(df)
    assert len(models[8].values) == rows - 1 and models[8].identity_error < 1e-9
