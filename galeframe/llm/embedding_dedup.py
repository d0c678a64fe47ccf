"""Embedding near-dedup: int8 tile products with per-vector error bounds.

Every vector is scaled to unit length and quantised to int8 with a step of its own, and what the
rounding lost is quantised to int8 once more. For two vectors u = p + d and v = q + f (p, q the
quantised ones) the cosine differs from p.q by at most |p||f| + |d||q| + |d||f|. Tiles of int8
products settle most pairs either way; pairs whose interval holds the threshold are looked at again
with both codes, whose interval is a hundred times as narrow; the few that are still open leave the
tile as pairs and are computed from the full vectors in double precision. So a tile needs two bytes
a component, and full vectors travel only for open pairs.

Rounding: products of int8 are whole numbers and their sums in float32 are exact below 2**24, so
they are taken over 1024 components at a time and added in float64; what the scaling in float32 can
add is covered by _ROUNDING. The second look is done in float64.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing, and neither do rows with a null vec_id; vectors of different lengths are never compared;
equal vectors collapse to one before the tiles and count with their number; rows of different
vectors under one vec_id count as one node. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import connected_components, stored

#: Values are at most 1.1; steps rounded to float32, and two products of them, are off by 2**-24 each.
_ROUNDING = 1.1 * 8 * 2.0**-24
_EXACT_DIM = 1024
_PACKED = "rep long, many long, dim int, code binary, step double, lost double, more binary, more_step double, more_lost double, full binary"


def usable(vector: str) -> F.Column:
    """A vector of finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _quantised(u: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(int8 code, step, what the rounding lost)."""
    step = float(np.abs(u).max()) / 127
    code = np.rint(u / step).astype(np.int8) if step > 0 else np.zeros(len(u), np.int8)
    return code, step, u - step * code


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both codes of each unit vector with their steps and lost lengths, and the unit vector itself."""
    for batch in batches:
        out: list[list] = [[] for _ in range(10)]
        for rep, many, vector in zip(batch.column("rep").to_pylist(), batch.column("many").to_pylist(), batch.column("vector"), strict=True):
            v = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            v = v / np.abs(v).max()  # no overflow in the length
            u = v / math.sqrt(float(v @ v))
            code, step, d = _quantised(u)
            more, more_step, rest = _quantised(d)
            for held, x in zip(out, (rep, many, len(u), code.tobytes(), step, float(np.linalg.norm(d)) + 1e-12, more.tobytes(), more_step, float(np.linalg.norm(rest)) + 1e-12, u.tobytes()), strict=True):
                held.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.binary(), pa.float64(), pa.float64(), pa.binary())
        names = [c.split()[0] for c in _PACKED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)


class _Side:
    """One block of a tile."""

    def __init__(self, table: pa.Table):
        dim = table.column("dim")[0].as_py()
        joined = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.int8).reshape(-1, dim)
        number = lambda c: table.column(c).to_numpy()
        self.rep, self.many = number("rep"), number("many").astype(np.float64)
        self.step, self.lost, self.more_step, self.more_lost = (number(c) for c in ("step", "lost", "more_step", "more_lost"))
        self.code, self.more = joined("code"), joined("more")
        self.size = self.step * np.sqrt((self.code.astype(np.float64) ** 2).sum(axis=1))

    def finer(self, rows: np.ndarray) -> np.ndarray:
        """Rows by both codes."""
        return self.code[rows] * self.step[rows, None] + self.more[rows] * self.more_step[rows, None]


def _products(a: _Side, b: _Side, r: slice, c: slice) -> np.ndarray:
    """Products of the first codes; whole numbers are exact in float32 up to 2**24."""
    dim = a.code.shape[1]
    part = lambda x, y, k: x.code[y, k : k + _EXACT_DIM].astype(np.float32)
    if dim <= _EXACT_DIM:
        near = part(a, r, 0) @ part(b, c, 0).T
        near *= a.step[r, None].astype(np.float32)
        near *= b.step[None, c].astype(np.float32)
        return near
    near = sum((part(a, r, k) @ part(b, c, k).T).astype(np.float64) for k in range(0, dim, _EXACT_DIM))
    return near * a.step[r, None] * b.step[None, c]


def _linked(a: _Side, b: _Side, r: slice, c: slice, threshold: float, same: bool) -> tuple[np.ndarray, ...]:
    """(i, j, open i, open j): pairs of rows within the slices whose cosine is surely the threshold or more, and those that the codes leave open."""
    near = _products(a, b, r, c)
    ea, eb, na, nb = a.lost[r], b.lost[c], a.size[r], b.size[c]
    widest = na.max() * eb.max() + ea.max() * nb.max() + ea.max() * eb.max() + _ROUNDING
    i, j = np.nonzero(near >= near.dtype.type(threshold - widest - _ROUNDING))
    if same:
        other = i + r.start != j + c.start
        i, j = i[other], j[other]
    bound = na[i] * eb[j] + ea[i] * nb[j] + ea[i] * eb[j] + _ROUNDING
    mid = near[i, j].astype(np.float64)
    sure = mid - bound >= threshold
    left = np.flatnonzero(~sure & (mid + bound >= threshold))
    undecided = np.zeros(len(i), bool)
    for k in range(0, len(left), 1 << 15):
        o = left[k : k + (1 << 15)]
        x, y = i[o] + r.start, j[o] + c.start
        u, v = a.finer(x), b.finer(y)
        mid = np.einsum("ij,ij->i", u, v)
        bound = np.linalg.norm(u, axis=1) * b.more_lost[y] + a.more_lost[x] * np.linalg.norm(v, axis=1) + a.more_lost[x] * b.more_lost[y] + 1e-12
        sure[o] = mid - bound >= threshold
        undecided[o] = ~sure[o] & (mid + bound >= threshold)
    return i[sure] + r.start, j[sure] + c.start, i[undecided] + r.start, j[undecided] + c.start


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        at = table.column("block").to_numpy()
        lo, hi = int(at.min()), int(at.max())
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        if one or lo == hi:
            if not one:  # the other block is empty
                return _EMPTY
            a = b = _Side(table)
        else:
            a, b = _Side(table.filter(pa.array(at == lo))), _Side(table.filter(pa.array(at == hi)))
        na, nb = len(a.rep), len(b.rep)
        links, open_pairs = [np.zeros(na), np.zeros(nb)], []
        root = np.arange(na + (0 if one else nb))
        shift = 0 if one else na

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        high, wide = 512, 4096
        for x in range(0, na, high):
            for y in range(0, nb, wide):
                i, j, oi, oj = _linked(a, b, slice(x, min(x + high, na)), slice(y, min(y + wide, nb)), threshold, one)
                if len(oi):
                    fresh = oi < oj if one else np.ones(len(oi), bool)
                    open_pairs.append((a.rep[oi[fresh]], b.rep[oj[fresh]]))
                if not len(i):
                    continue
                np.add.at(links[0], i, b.many[j])
                if not one:
                    np.add.at(links[1], j, a.many[i])
                # within the sub-tile: spread the smallest number over the links, then join roots
                label = np.arange(len(root))
                while True:
                    was = label.copy()
                    np.minimum.at(label, j + shift, label[i])
                    np.minimum.at(label, i, label[j + shift])
                    if (was == label).all():
                        break
                for k in np.flatnonzero(label != np.arange(len(root))):
                    p, q = find(int(k)), find(int(label[k]))
                    root[max(p, q)] = min(p, q)
        rep = a.rep if one else np.concatenate([a.rep, b.rep])
        n = links[0] if one else np.concatenate(links)
        some = np.flatnonzero(n > 0)
        to = np.array([find(int(k)) for k in some], np.int64)
        x, y = (np.concatenate([p[k] for p in open_pairs]) if open_pairs else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"rep": np.concatenate([rep[some], x]), "links": np.concatenate([n[some].astype(np.int64), np.full(len(x), -1)]), "to": np.concatenate([rep[to] if len(some) else np.zeros(0, np.int64), y])})

    return run


_EMPTY = pa.table({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})


def _settled(threshold: float):
    """Of open pairs with both full vectors those whose cosine is the threshold or more, from either end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64) for c in ("full_a", "full_b"))
            first = np.concatenate([[0], np.cumsum(batch.column("dim").to_numpy())]).astype(np.int64)
            cosine = np.add.reduceat(left * right, first[:-1]) if batch.num_rows else np.zeros(0)
            good = pa.array(cosine >= threshold)
            a, b, ma, mb = (batch.column(c).filter(good) for c in ("a", "b", "many_a", "many_b"))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([mb, ma]), pa.concat_arrays([b, a])], names=["rep", "links", "to"])

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, block_rows: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept; threshold lies in (0, 1].

    Distinct vectors are dealt by a hash to blocks of about block_rows; each pair of blocks is a
    tile, one group of at most two blocks whatever the data. A tile returns one row per linked
    vector: its number of links there and one member of its group; of pairs only those that both
    codes leave open, within about a ten-thousandth of the threshold.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("fine", usable("vector") & F.col("vec_id").isNotNull())
    rows = rows.withColumn("key", F.when(F.col("fine"), F.md5(F.array_join(F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")), ","))))
    slim = rows.select("vec_id", "key")
    distinct = rows.where("fine").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("vector").alias("vector"))
    packed = stored(distinct.select("rep", "many", "vector").mapInArrow(_pack, _PACKED))
    n = packed.count()
    blocks = max(1, math.ceil(n / block_rows), min(8, math.ceil(n / 512)))  # eight for a small table too, to share the work
    dealt = packed.drop("full").withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    paired = dealt.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": F.least("block", "g"), "j": F.greatest("block", "g")}).drop("g")
    found = stored(paired.groupBy("dim", "i", "j").applyInArrow(_tile(threshold), "rep long, links long, to long"))
    side = lambda x: packed.select(F.col("rep").alias(x), F.col("many").alias(f"many_{x}"), F.col("full").alias(f"full_{x}"))
    doubtful = found.where("links < 0").select(F.col("rep").alias("a"), F.col("to").alias("b"))
    doubtful = doubtful.join(side("a"), "a").join(side("b").withColumn("dim", (F.octet_length("full_b") / 8).cast("int")), "b")
    exact = doubtful.select("a", "b", "many_a", "many_b", "dim", "full_a", "full_b").mapInArrow(_settled(threshold), "rep long, links long, to long")
    found = stored(found.where("links >= 0").unionByName(exact))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("rep", "to")).withColumnsRenamed({"node": "rep"})
    reps = distinct.select("key", "rep", "many").join(counts, "rep", "left").join(groups, "rep", "left")
    reps = reps.select("key", F.coalesce("links", F.lit(0)).alias("links"), "many", F.coalesce("component", "rep").alias("component"))
    out = slim.join(reps, "key", "left")
    return out.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("many") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )
