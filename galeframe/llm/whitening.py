"""Embedding whitening from an exact scatter in residue numbers.

Vectors are put on a grid of whole numbers, x = floor(scale * c) + shift, and each distinct one
counts once (the fit list, n of them, with sums S). The scatter of y = n * x - S, which is centred
and whole, is taken modulo several primes below 2**20: a partition multiplies the residues of its
rows as matrices of doubles, which is exact as long as a product has at most 32768 rows, and keeps
one matrix a prime. The partitions' matrices are added row by row, and the Chinese remainder theorem
gives the scatter itself, as whole numbers of any length; the primes are as many as its bound asks.
V = scatter / n**3 is then rounded once, eigh in double precision gives the components, and each
eigenvalue is read off the exact scatter along its component. What reaches the driver has the size
of the scatter: the square of the dimension, times the number of primes.

Edge cases: vectors that are null or hold null or non-finite entries take no part and have a null
result; empty vectors have no components. Vectors of each length are a fit list of their own. An
entry beyond 2**62 on the grid counts as 2**62 (-2**62). An eigenvalue not above dimension * 2**-52
times the largest cannot be told from zero in double precision, and its component is left out; so
one vector, or only equal ones, have no components. A deviation beyond a long is null. Rows keep
their other columns, whatever their names; one named whitened is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import added, column_at, scratch, with_made

_PRIME = 1 << 20
_ROWS = 1 << 15  # residues lie within 2**19 of zero: so many products of two stay below 2**53
_LIMIT = float(1 << 62)


@dataclass
class Whitening:
    """What a fit learns about vectors of one length."""

    n: int
    sums: list[int]
    reach: int  # the largest |n * x - S| on the fit list
    components: np.ndarray  # unit vectors, a column each
    values: np.ndarray  # their eigenvalues
    explained: np.ndarray
    identity_error: float = math.nan

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S for rows x on the grid, exactly; as Python's numbers where a long is too short."""
        far = max((abs(int(v) * self.n - s) for ext in (x.min(axis=0), x.max(axis=0)) for v, s in zip(ext, self.sums, strict=True)), default=0) if len(x) else 0
        if far < 1 << 62:  # n * (x - floor(S / n)) - rest never leaves the longs then
            floor = np.array([s // self.n for s in self.sums], np.int64)
            rest = np.array([s % self.n for s in self.sums], np.int64)
            return (x - floor) * self.n - rest
        return x.astype(object) * self.n - np.array(self.sums, object)

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened coordinates of centred rows."""
        return (y / self.n).astype(np.float64) @ (self.components / np.sqrt(self.values))

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum over dimensions of y squared, exactly; None beyond a long."""
        if y.dtype != object and (not y.size or float(np.abs(y).max()) ** 2 * y.shape[1] < 2.0**62):
            return (y * y).sum(axis=1).tolist()
        sums = [sum(v * v for v in row) for row in y.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def on_grid(vector: Column, scale: int, shift: int) -> Column:
    """array<long> floor(scale * c) + shift; null for vectors that are null or hold null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    wide = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(_LIMIT)), F.lit(-_LIMIT))).cast("long") + F.lit(shift).cast("long"))
    return F.when(vector.isNotNull() & finite, wide)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, rows) of the vectors of each length that a column of lists holds, without null and empty ones."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(size) - size
    for d in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == d)
        for k in range(0, len(at), _ROWS):
            some = at[k : k + _ROWS]
            yield some, flat[first[some][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows d, i, n, high, low, least, most: sums of the upper and lower 32 bits, so that no sum leaves the longs."""
    held: dict[int, list] = {}
    for batch in batches:
        for _, x in _matrices(batch.column(0)):
            new = [len(x), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
            old = held.get(x.shape[1])
            held[x.shape[1]] = [old[0] + new[0], old[1] + new[1], old[2] + new[2], np.minimum(old[3], new[3]), np.maximum(old[4], new[4])] if old else new
    for d, (n, *columns) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), *map(pa.array, columns)], names=["d", "i", "n", "high", "low", "least", "most"])


def primes(bound: int) -> list[int]:
    """The largest primes below 2**20, until their product is above bound."""
    sieve = np.ones(_PRIME, bool)
    sieve[:2] = False
    for k in range(2, int(_PRIME**0.5) + 1):
        if sieve[k]:
            sieve[k * k :: k] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > bound:
            break
        out.append(p)
        product *= p
    else:
        raise ValueError("values too large for the primes below 2**20")
    return out


def _residues(x: np.ndarray, n: int, sums: list[int], p: int) -> np.ndarray:
    """n * x - S modulo p, in doubles around zero."""
    r = ((x % p) * (n % p) - np.array([s % p for s in sums], np.int64)) % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def _products(plan: dict[int, tuple[int, list[int], list[int]]]):
    """For mapInArrow: a partition's rows d, prime, i, row of the scatter modulo that prime. plan: n, S and primes of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                d = x.shape[1]
                n, sums, moduli = plan[d]
                for p in moduli:
                    r = _residues(x, n, sums, p)
                    held[d, p] = (held.get((d, p), 0) + (r.T @ r).astype(np.int64)) % p
        for (d, p), m in held.items():
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d, dtype=np.int32)), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array([p] * d, pa.int64()), pa.array(range(d), pa.int32()), lists], names=["d", "p", "i", "row"])

    return run


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    """The partitions' rows of one line of one scatter, added modulo its prime."""
    d, p, i = (k.as_py() for k in key)
    total = np.zeros(d, np.int64)
    for part in rows.column("row").chunks:
        total = (total + part.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).sum(axis=0)) % p
    return pa.table({"d": pa.array([d], pa.int32()), "p": pa.array([p], pa.int64()), "i": pa.array([i], pa.int32()), "row": pa.array([total.tolist()], pa.list_(pa.int64()))})


def reconstructed(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The whole numbers, of either sign, that leave these residues, by the Chinese remainder theorem; residues: prime -> matrix."""
    product = math.prod(residues)
    total = np.zeros(next(iter(residues.values())).shape, object)
    for p, m in residues.items():
        rest = product // p
        total += m.astype(object) * (rest * pow(rest, -1, p))
    total %= product
    return np.where(total > product // 2, total - product, total)


def _solved(n: int, sums: list[int], reach: int, scatter: np.ndarray, components: int) -> Whitening:
    """Components of V = scatter / n**3, by falling eigenvalue."""
    cube, d = n**3, len(sums)
    v = np.array([[int(c) / cube for c in line] for line in scatter], np.float64).reshape(d, d)
    trace = sum(int(scatter[i][i]) for i in range(d)) / cube
    found, vectors = np.linalg.eigh(v)
    top = np.argsort(-found, kind="stable")[:components]
    top = top[found[top] > max(found.max(initial=0.0), 0.0) * d * 2.0**-52]
    q = vectors[:, top]
    whole = np.array([[round(x * 2.0**60) for x in line] for line in q.tolist()], object).reshape(q.shape)
    exact = [int(whole[:, k] @ (scatter @ whole[:, k])) / (int(whole[:, k] @ whole[:, k]) * cube) for k in range(q.shape[1])]
    e = np.array(exact, np.float64)
    order = np.argsort(-e, kind="stable")
    return Whitening(n, sums, reach, q[:, order], e[order], e[order] / trace if trace else e[order])


def _spread(models: dict[int, Whitening]):
    """For mapInArrow: a partition's rows d, place, value of the sum of products of whitened coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                model = models[x.shape[1]]
                w = model.project(model.centred(x))
                held[x.shape[1]] = held.get(x.shape[1], 0.0) + w.T @ w
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], names=["d", "i", "value"])

    return run


def fit(df: DataFrame, vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 16) -> dict[int, Whitening]:
    """A Whitening for each length of vector that occurs.

    The distinct vectors are written to the shared folder while the fit lasts; they are read for the
    sums, for the scatter and for the check of the outcome.
    """
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    x = on_grid(F.col(f"c{column_at(df, vector)}"), scale, shift)
    with scratch(df.sparkSession) as store:
        rows = store(plain.select(x.alias("x")).where("size(x) > 0").distinct())
        parts = rows.mapInArrow(_sums, "d int, i int, n long, high long, low long, least long, most long")
        whole = "decimal(38,0)"
        found = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("high").cast(whole)).alias("high"), F.sum(F.col("low").cast(whole)).alias("low"), F.min("least").alias("least"), F.max("most").alias("most"))
        plan, reach = {}, {}
        by: dict[int, list] = {}
        for r in found.collect():  # one row a dimension
            by.setdefault(r.d, []).append(r)
        for d, own in by.items():
            own.sort(key=lambda r: r.i)
            n, sums = own[0].n, [(int(r.high) << 32) + int(r.low) for r in own]
            reach[d] = max(max(abs(n * r.most - s), abs(n * r.least - s)) for r, s in zip(own, sums, strict=True))
            plan[d] = (n, sums, primes(2 * n * reach[d] ** 2 + 1))
        if not plan:
            return {}
        lines = rows.mapInArrow(_products(plan), "d int, p long, i int, row array<long>").groupBy("d", "p", "i").applyInArrow(_added, "d int, p long, i int, row array<long>")
        residues: dict[int, dict[int, np.ndarray]] = {d: {p: np.zeros((d, d), np.int64) for p in moduli} for d, (_, _, moduli) in plan.items()}
        for r in lines.toLocalIterator():  # dimension x primes rows of a dimension's length
            residues[r.d][r.p][r.i] = r.row
        models = {d: _solved(n, sums, reach[d], reconstructed(residues.pop(d)), components) for d, (n, sums, _) in plan.items()}
        spread = rows.mapInArrow(_spread(models), "d int, i int, value double").groupBy("d", "i").agg(F.sum("value").alias("value"))
        for d, m in models.items():
            m.identity_error = 0.0
        for r in spread.collect():  # components squared rows a length
            m = models[r.d]
            k = len(m.values)
            m.identity_error = max(m.identity_error, abs(r.value / m.n - (r.i // k == r.i % k)))
    return models


KIND = "struct<deviation:long,values:array<double>>"


def _whitened(models: dict[int, Whitening]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = batch.column("read")
            deviation: list[int | None] = [None] * batch.num_rows
            values: list[np.ndarray | None] = [None if not v else np.zeros(0) for v in read.is_valid().to_pylist()]
            for at, x in _matrices(read):
                model = models[x.shape[1]]
                y = model.centred(x)
                for k, s, w in zip(at.tolist(), model.deviations(y), model.project(y), strict=True):
                    deviation[k], values[k] = s, w
            made = pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), pa.array(values, pa.list_(pa.float64()))], names=["deviation", "values"], mask=read.is_null())
            yield added(batch, made)

    return run


def transform(df: DataFrame, models: dict[int, Whitening], vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """df with whitened struct<deviation, values>: the exact sum of squares of n * x - S, and a coordinate for each component; null for vectors that take no part.

    The models must come from a fit over rows that hold these vectors' lengths.
    """
    names = df.columns
    stand = df.toDF(*(f"c{k}" for k in range(len(names))))
    x = on_grid(F.col(f"c{column_at(df, vector)}"), scale, shift).alias("x")
    out = with_made(stand.select("*", x), "x", "w", KIND, _whitened(models)).drop("x")
    kept = [k for k, c in enumerate(names) if c.lower() != "whitened"]
    return out.select(*(f"c{k}" for k in kept), "w").toDF(*(names[k] for k in kept), "whitened")


def coordinates(df: DataFrame, models: dict[int, Whitening], vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each vector that takes part and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    The last is that of the vector's length: the largest absolute entry of the whitened fit list's covariance minus the identity.
    """
    told = F.create_map(*(v for d, m in models.items() for v in (F.lit(d), F.struct(F.lit(m.n).cast("long").alias("n"), F.lit(m.identity_error).alias("error"), F.array(*(F.lit(float(e)) for e in m.explained)).cast("array<double>").alias("explained"))))) if models else F.lit(None).cast("map<int,struct<n:long,error:double,explained:array<double>>>")
    rows = transform(df.select(key, vector), models, vector).where("whitened IS NOT NULL")
    rows = rows.select(key, F.col("whitened.deviation").alias("deviation"), told[F.size(F.col(vector))].alias("m"), F.posexplode("whitened.values").alias("k", "whitened"))
    return rows.select(key, (F.col("k") + 1).cast("int").alias("component"), F.col("m.n").alias("n"), "deviation", "whitened", F.col("m.explained")[F.col("k")].alias("explained"), F.col("m.error").alias("identity_error"))
