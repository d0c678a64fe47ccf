"""Exact top-k by an impact-ordered index, score at a time.

Components are whole numbers floor(scale * x). A block of candidate vectors is indexed by
dimension: its postings, sorted by value, are cut into segments of equal quantised impact
(value // step). For a query each segment's impact is measured above the least that its dimension
can give in the block, and segments are processed in descending impact, adding exact products to
accumulators. What the dimensions' next segments could still add bounds every candidate's score
from above, so the search may stop only when the bound proves that few candidates can still be
among the best k; these possible members are then scored exactly from their vectors. Queries go in
groups: a segment comes in its turn by its largest impact for any of them, and its postings are
read once and added to all their accumulators.

Codes are int64 where a component stays below 2**28. A row beyond that is wide: its code is text of
whole numbers of any length, made exactly from the doubles, and its products are added as Python
ints. Blocks whose bound on all sums of products could pass a long are scored in the same way, so
no score wraps; a query with a score in its best k that does not fit a long raises an error.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows with a null id; a query is never matched
with rows of its own id; queries see candidates of their own length only; repeated rows count as
candidates each, as queries once; fewer than k candidates give fewer rows. Other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.common import stored

_HITS = "query_id long, vec_id long, score long"
WIDE = 2**28
_TOGETHER = 64  # queries that share a pass over the postings
_LOOKS = (7 / 8,)  # shares of the postings after which bounds are looked at
_UNFIT = "a score among a query's best does not fit a long"


class ImpactIndex:
    """The postings of one block, by dimension and quantised impact."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, step: int = 16):
        self.ids, self.values = ids, values
        self.order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T)  # row d: the postings of dimension d
        self.sorted = np.take_along_axis(np.ascontiguousarray(values.T), self.order, axis=1)
        self.segments: list[tuple[int, int, int]] = []
        low, high = [], []
        for d in range(values.shape[1]):
            ranked = self.sorted[d]
            cuts = np.flatnonzero(np.diff(ranked // step)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(ranked)], strict=True):
                self.segments.append((d, int(s), int(e)))
                low.append(ranked[s])
                high.append(ranked[e - 1])
        self.dim = np.array([d for d, _, _ in self.segments])
        self.sizes = np.array([e - s for _, s, e in self.segments])
        self.low, self.high = np.array(low, np.int64), np.array(high, np.int64)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best k, ties to smaller ids."""
        return self.search_all(np.array([query_id]), query[None, :], k)[0]

    def search_all(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """search() for some queries at once: a segment's postings are read once and added to the accumulators of all of them."""
        n, dims = self.values.shape
        q = queries[:, self.dim]
        first = np.searchsorted(self.dim, np.arange(dims))  # segments lie in the order of their dimensions
        least = np.minimum.reduceat(np.minimum(q * self.low, q * self.high), first, axis=1)
        impact = np.maximum(q * self.low, q * self.high) - least[:, self.dim]
        turn = np.argsort(-impact.max(axis=0), kind="stable")
        ends = np.cumsum(self.sizes[turn])
        # little is ruled out before most postings are added
        stops = [*np.unique(np.searchsorted(ends, [int(ends[-1] * f) for f in _LOOKS])), len(turn)]
        span = int(np.maximum.reduceat(impact, first, axis=1).sum(axis=1).max())
        kind = np.int32 if max(span, int(np.abs(least).max()), int(np.abs(self.values).max()) * int(np.abs(queries).max())) < 2**30 else np.int64
        gained = np.zeros((n, len(queries)), kind)
        by_dim, lowest, ranked = queries.T.astype(kind), least.T.astype(kind), self.sorted.astype(kind)
        at, possible, goal = 0, [np.flatnonzero(self.ids != i) for i in query_ids.tolist()], max(8 * k, n // 16)  # so few are cheaper to score than to narrow down further
        for stop in stops:
            for t in turn[at:stop].tolist():
                d, s, e = self.segments[t]
                gained[self.order[d, s:e]] += ranked[d, s:e, None] * by_dim[d] - lowest[d]
            at = int(stop)
            ahead = impact.copy()
            ahead[:, turn[:at]] = 0
            rest = np.maximum.reduceat(ahead, first, axis=1).sum(axis=1)  # what the dimensions can still add
            for j, left in enumerate(rest.tolist()):
                if len(possible[j]) > k:
                    held = gained[possible[j], j].astype(np.int64)
                    kth = np.partition(held, len(held) - k)[len(held) - k]
                    possible[j] = possible[j][held + left >= kth]  # proof: all others end below the kth
            if max(map(len, possible)) <= goal:
                break
        out = []
        for j, rows in enumerate(possible):
            score = self.values[rows] @ queries[j]
            best = np.lexsort((self.ids[rows], -score))[:k]
            out.append((rows[best], score[best]))
        return out


def _ints(code: bytes) -> list[int]:
    """The components of a code, wide or not."""
    return [int(x) for x in code[1:].split(b",")] if code[:1] == b"w" else np.frombuffer(code, np.int64, offset=1).tolist()


class Block:
    """A block of candidates: the narrow ones in an index, all or the wide ones as Python ints where longs do not hold."""

    def __init__(self, ids: np.ndarray, codes: list[bytes], step: int):
        self.ids, self.codes = ids, codes
        narrow = np.array([c[:1] != b"w" for c in codes], bool)
        self.rows = {"all": np.arange(len(ids)), "wide": np.flatnonzero(~narrow)}
        self.ints: dict[str, np.ndarray] = {}
        self.index, self.limit = None, 0
        if narrow.any():
            values = np.frombuffer(b"".join(c[1:] for c in codes if c[:1] != b"w"), np.int64).reshape(int(narrow.sum()), -1)
            self.index, self.limit = ImpactIndex(ids[narrow], values, step), int(np.abs(values).max())

    def exact(self, which: str, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """(score, id) of the best k of all or the wide rows by Python ints, ties to smaller ids."""
        rows = self.rows[which]
        if not len(rows):
            return []
        if which not in self.ints:
            self.ints[which] = np.array([_ints(self.codes[r]) for r in rows], object)
        scored = zip((self.ints[which] @ np.array(query, object)).tolist(), self.ids[rows].tolist(), strict=True)
        return sorted((x for x in scored if x[1] != query_id), key=lambda x: (-x[0], x[1]))[:k]

    def search(self, query_ids: list[int], codes: list[bytes], k: int) -> list[list[tuple[int, int]]]:
        """(score, id) of each query's best k; the index is asked only where longs are proved to hold."""
        queries = [_ints(c) for c in codes]
        # sums of products, of their spreads and of what is left stay below 2**63 then
        fit = [j for j, c in enumerate(codes) if self.index is not None and c[:1] != b"w" and sum(map(abs, queries[j])) * self.limit < 2**61]
        out = {j: self.exact("all", query_ids[j], queries[j], k) for j in set(range(len(codes))) - set(fit)}
        for lo in range(0, len(fit), _TOGETHER):
            some = fit[lo : lo + _TOGETHER]
            met = self.index.search_all(np.array([query_ids[j] for j in some]), np.array([queries[j] for j in some], np.int64), k)
            for j, (at, score) in zip(some, met, strict=True):
                found = [*zip(score.tolist(), self.index.ids[at].tolist(), strict=True), *self.exact("wide", query_ids[j], queries[j], k)]
                out[j] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
        return [out[j] for j in range(len(codes))]


def _long(score: int) -> int | None:
    """The score, or null below the longs: such a row may still be outdone in other blocks, one above may not."""
    if score >= 2**63:
        raise OverflowError(_UNFIT)
    return score if score >= -(2**63) else None


def _tile(k: int, step: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        is_query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        codes = table.column("code").to_pylist()
        out: list[tuple[int, int, int | None]] = []
        if is_query.any() and not is_query.all():
            block = Block(ids[~is_query], [codes[r] for r in np.flatnonzero(~is_query)], step)
            asked = ids[is_query].tolist()
            for i, found in zip(asked, block.search(asked, [codes[r] for r in np.flatnonzero(is_query)], k), strict=True):
                out += [(i, j, _long(score)) for score, j in found]
        return pa.table({n: pa.array([x[c] for x in out], pa.int64()) for c, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def _pack(scale: int):
    def run(batches):
        for batch in batches:
            codes = []
            for v in batch.column("v"):
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(over="ignore"):
                    scaled = np.floor(x * float(scale))
                if (np.abs(scaled) < WIDE).all():
                    codes.append(b"n" + scaled.astype(np.int64).tobytes())
                else:  # a product beyond the doubles is whole already
                    codes.append(b"w" + b",".join(b"%d" % (int(y) if np.isfinite(y) else int(a) * scale) for y, a in zip(scaled.tolist(), x.tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("dim"), pa.array(codes, pa.binary())], names=["id", "dim", "code"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, step: int = 16, block_rows: int = 16_384, query_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest integer inner products over all other rows.

    Candidates are dealt to blocks of about block_rows, queries to blocks of about query_rows; each
    pair of blocks is one bounded group, which returns k rows a query, and the last ranking sees
    k rows for each query and candidate block.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(fine, F.lit(False)))
    coded = rows.select("id", F.size("v").alias("dim"), F.col("v").cast("array<double>").alias("v"))
    packed = stored(coded.mapInArrow(_pack(scale), "id long, dim int, code binary"))
    asked = rows.where("asked").select("id").distinct()
    queries = stored(packed.join(asked, "id", "left_semi").distinct())
    n, m = packed.count(), queries.count()
    nb, mb = max(1, math.ceil(n / block_rows)), max(1, math.ceil(m / query_rows))
    salt = F.pmod(F.xxhash64("id", "code", F.monotonically_increasing_id()), F.lit(nb)).cast("int")  # repeated rows part too
    spread = lambda df, at, other, blocks: df.withColumn(at, df[at]).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ours = spread(stored(packed.withColumn("c", salt)), "c", "q", mb).withColumn("is_query", F.lit(False))
    theirs = spread(queries.withColumn("q", F.pmod(F.xxhash64("id", "code"), F.lit(mb)).cast("int")), "q", "c", nb).withColumn("is_query", F.lit(True))
    hits = ours.select("dim", "c", "q", "id", "code", "is_query").unionByName(theirs.select("dim", "c", "q", "id", "code", "is_query"))
    hits = hits.groupBy("dim", "c", "q").applyInArrow(_tile(k, step), _HITS)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.coalesce("score", F.raise_error(F.lit(_UNFIT)).cast("long")).alias("score"))
