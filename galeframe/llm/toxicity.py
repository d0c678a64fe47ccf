"""Toxicity by maximum-scoring segments over token log-odds.

Units are words and the beginnings of words. Their log-odds between toxic and clean labelled texts
take an informative Dirichlet prior, the units' rates over all labelled texts; a unit is kept when
its log-odds are at least min_delta and min_z standard deviations, and those of the texts that have it at
least min_delta too. A word scores the largest
log-odds of its kept units, any other word a small loss that makes the scores log-odds of the two
classes' words. One linear scan finds every maximal scoring segment of a text. Under clean texts
the best segment of n words exceeds s with probability about 1 - exp(-K n exp(-lambda s)); lambda
comes from the clean words' scores, K from the clean texts' best segments. Segments that are rarer
than max_e under that law are the toxic passages; how far they lie beyond it, calibrated by a
logistic curve, is the score.

The classifier is fitted on a sample of at most about max_rows labelled texts (chosen by a hash of
doc_id) and holds at most max_units units, both parameters; scoring reads every whole text, and
neither labels nor other columns enter a score.

Edge cases: null and empty texts score like texts without any kept unit; a null doc_id is scored
and never learnt from; several labels of one document count as toxic if one is; without labels of
both classes every score is the clean share. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import column_at, stored, text_slices
from galeframe.llm.textkit import U, Words, mix, raw_bytes, windows, words

PREFIXES = (4, 5, 6, 7, 8, 9, 10, 12)
_SALT = U(0x51ED270B4D2C6E3D)


@dataclass(frozen=True)
class ToxicityConfig:
    """max_rows and max_units bound the fit; the prior weighs as many words as prior says."""

    max_rows: int = 20_000
    max_units: int = 65_536
    min_docs: int = 4
    prior: float = 10_000.0
    min_delta: float = 1.0
    min_z: float = 4.0
    max_delta: float = 6.0
    max_e: float = 0.05


@dataclass
class ToxicityModel:
    """Kept units in order of their hashes with their scores, and the calibration."""

    units: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    delta: np.ndarray = field(default_factory=lambda: np.zeros(0))
    other: float = -0.01
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float, float] = (-4.0, 0.0, 0.0)
    max_e: float = 0.05

    def __post_init__(self):
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.units & U((1 << 22) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in hashes, unit numbers) of the kept units among hashes."""
        at = np.flatnonzero(self.maybe[(hashes & U((1 << 22) - 1)).astype(np.int64)])
        if not len(at) or not len(self.units):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where = np.minimum(np.searchsorted(self.units, hashes[at]), len(self.units) - 1)
        good = self.units[where] == hashes[at]
        return at[good], where[good]

    def best(self, found: Words) -> np.ndarray:
        """Each word's best unit, or -1."""
        best = np.full(len(found.starts), -1)
        score = np.zeros(len(found.starts))
        for at, h in unit_hashes(found):
            i, unit = self.find(h)
            w = at[i]
            up = self.delta[unit] > score[w]
            best[w[up]], score[w[up]] = unit[up], self.delta[unit[up]]
        return best


def unit_hashes(found: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, hashes) of whole words, then of the beginnings of each length."""
    size = found.ends - found.starts
    yield np.arange(len(size)), mix(found.hashes() ^ _SALT)
    for n in PREFIXES:
        long = np.flatnonzero(size >= n)
        yield long, found.hashes(found.starts[long], found.starts[long] + n)


def maximal_segments(start: np.ndarray, gain: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, word after the last, score) of a text.

    start: the words with a gain, in order; every other word scores other (negative). Segments are
    kept as (sum before, sum after) on a stack, each with the place of the nearest one to its left
    that begins lower. A search for such a place follows these links: what a link passes over begins
    no lower than the segment it belongs to. So each segment is passed, joined or pushed once.
    """
    held: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for w, g in zip(start.tolist(), gain.tolist(), strict=True):
        total += other * (w - last - 1)
        a, before, after = w, total, total + g
        lower = len(held) - 1
        while True:
            while lower >= 0 and held[lower][2] >= before:
                lower = held[lower][4]
            if lower < 0 or held[lower][3] >= after:
                break
            a, _, before, _, joined = held[lower]
            del held[lower:]
            lower = joined
        held.append((a, w + 1, before, after, lower))
        total, last = after, w
    return [(a, b, after - before) for a, b, before, after, _ in held]


def _features(model: ToxicityModel, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float, list]:
    """How far the best segment, and all significant ones together, lie beyond chance; and those."""
    chance = math.log(model.k * max(n, 1))
    beyond = [(model.lam * s - chance, a, b, s) for a, b, s in segments]
    far = [x for x in beyond if x[0] > -math.log(model.max_e)]
    top = max((x[0] for x in beyond), default=-chance)
    return min(max(top, -15.0), 40.0), math.log1p(sum(x[0] for x in far)), far


@dataclass
class _Scan:
    """Of a slice of texts: words that have a unit (number in the slice, best unit, bytes of beginning and end), and each text's first word."""

    word: np.ndarray
    unit: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def _scan(model: ToxicityModel, column: pa.Array) -> _Scan:
    """Stretch by stretch, so that a very long text is held as its hits only."""
    parts, first, seen = [], np.zeros(len(column) + 1, np.int64), 0
    for at, found in windows(column):
        best = model.best(found)
        hit = np.flatnonzero(best >= 0)
        parts.append((hit + seen, best[hit], found.starts[hit] + at, found.ends[hit] + at))
        first += found.first
        seen += len(best)
    return _Scan(*(np.concatenate(x) for x in zip(*parts, strict=True)), first)


def _texts(model: ToxicityModel, column: pa.Array) -> Iterator[tuple[int, float, float, list, slice, _Scan]]:
    """(words, features, significant segments, the text's hits) of each text."""
    found = _scan(model, column)
    cut = np.searchsorted(found.word, found.first)
    for i in range(len(column)):
        own = slice(cut[i], cut[i + 1])
        segments = maximal_segments(found.word[own] - found.first[i], model.delta[found.unit[own]], model.other)
        n = int(found.first[i + 1] - found.first[i])
        yield n, *_features(model, n, segments), own, found


def _probability(model: ToxicityModel, top: float, sum_: float) -> float:
    w = model.weights
    return 1 / (1 + math.exp(-(w[0] + w[1] * top + w[2] * sum_)))


def _scored(model: ToxicityModel):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_words", pa.int64()), ("passages", pa.list_(pa.struct([("first_char", pa.int64()), ("end_char", pa.int64()), ("log_odds", pa.float64()), ("log_e", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                score, count, passages = [], [], []
                data, offsets = raw_bytes(pc.utf8_lower(pc.fill_null(part.column("text"), "")))
                for i, (n, top, sum_, far, hits, found) in enumerate(_texts(model, part.column("text"))):
                    score.append(_probability(model, top, sum_))
                    count.append(n)
                    own = []
                    if far:
                        chars = np.concatenate([[0], np.cumsum((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80)])
                        word, start, end = found.word[hits] - found.first[i], found.start[hits] - offsets[i], found.end[hits] - offsets[i]
                        for x, a, b, s in sorted(far, key=lambda x: x[1]):  # a segment begins and ends with a hit
                            own.append({"first_char": int(chars[start[np.searchsorted(word, a)]]), "end_char": int(chars[end[np.searchsorted(word, b - 1)]]), "log_odds": s, "log_e": -x})
                    passages.append(own)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(passages, schema.field("passages").type)], schema=schema)

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _unit_counts(cfg: ToxicityConfig):
    """Texts and occurrences of every unit, summed within each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = words(part.column("text"))
                text = found.texts
                h, owner = [np.concatenate(x) for x in zip(*((h, text[at]) for at, h in unit_hashes(found)), strict=True)]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
                pair = new | np.concatenate([[True], owner[1:] != owner[:-1]]) if len(h) else new
                at = np.flatnonzero(new)
                docs = np.add.reduceat(pair.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
                times = np.diff(np.append(at, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(docs), pa.array(times)], names=["unit", "docs", "times"])

    return run


def _known_counts(model: ToxicityModel, won: bool):
    """Per class: occurrences of the model's units (won: of each word's best unit only) and the texts that have them; unit -1 counts all words and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(model.units)
        times, docs = np.zeros((2, many + 1), np.int64), np.zeros((2, many + 1), np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = words(part.column("text"))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                text = found.texts
                times[:, -1] += np.bincount(toxic[text], minlength=2)
                docs[:, -1] += np.bincount(toxic, minlength=2)
                if won:
                    best = model.best(found)
                    hits = [(text[best >= 0], best[best >= 0])]
                else:
                    hits = [(text[at[i]], unit) for at, h in unit_hashes(found) for i, unit in [model.find(h)]]
                owner, unit = (np.concatenate(x) for x in zip(*hits, strict=True))
                np.add.at(times, (toxic[owner], unit), 1)
                pair = np.unique(owner * np.int64(many + 1) + unit)
                np.add.at(docs, (toxic[pair // (many + 1)], pair % (many + 1)), 1)
        c, u = np.nonzero(times + docs)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.where(u == many, -1, u)), pa.array(times[c, u]), pa.array(docs[c, u])], names=["toxic", "unit", "times", "docs"])

    return run


def _fit_rows(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = [(n, s_top, s_sum) for n, s_top, s_sum, *_ in _texts(model, part.column("text"))]
                n, top, sum_ = (np.array(x, float) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(n), pa.array(top), pa.array(sum_)], names=["toxic", "n", "top", "sum"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Learn from the labelled rows that are not held out.

    Only bounded tables reach the driver: at most max_units units, twice, and two numbers for each
    text of the sample.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > cfg.max_rows:
        share = 1 << 30
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) < int(share * cfg.max_rows / n))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    # the sample has at most about max_rows rows of 12 bytes, whatever the size of labels
    sample = stored(texts.join(F.broadcast(known), "doc_id").select("text", "toxic"))
    classes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(classes) < 2:
        only = next(iter(classes), 0)
        return ToxicityModel(weights=(-4.0 if only == 0 else 4.0, 0.0, 0.0), max_e=cfg.max_e)

    counts = sample.where("toxic = 1").select("text").mapInArrow(_unit_counts(cfg), "unit long, docs long, times long").groupBy("unit").agg(F.sum("docs").alias("docs"))
    often = counts.where(F.col("docs") >= cfg.min_docs).orderBy(F.desc("docs"), "unit").limit(cfg.max_units).select("unit").toPandas()
    units = np.sort(often["unit"].to_numpy(np.int64).view(U))

    def sums(model: ToxicityModel, won: bool) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        """(clean, toxic, all clean, all toxic) of occurrences, then of texts."""
        rows = sample.select("text", "toxic").mapInArrow(_known_counts(model, won), "toxic long, unit long, times long, docs long").groupBy("toxic", "unit").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs")).toPandas()
        out = []
        for c in ("times", "docs"):
            n = np.zeros((2, len(model.units) + 1))
            np.add.at(n, (rows["toxic"].to_numpy(), rows["unit"].to_numpy()), rows[c].to_numpy(float))  # unit -1 is the last
            out.append((n[0, :-1], n[1, :-1], n[0, -1], n[1, -1]))
        return out

    def log_odds(clean: np.ndarray, toxic: np.ndarray, all_clean: float, all_toxic: float, weight: float) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds between the classes under the Dirichlet prior, and in standard deviations."""
        prior = weight * (clean + toxic + 0.5) / (all_clean + all_toxic + 1)
        odds = lambda y, total: np.log((y + prior) / np.maximum(total + weight - y - prior, 1e-9))
        delta = odds(toxic, all_toxic) - odds(clean, all_clean)
        return delta, delta / np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))

    in_words, in_texts = sums(ToxicityModel(units, np.ones(len(units))), False)
    delta, z = log_odds(*in_words, cfg.prior)
    by_text, _ = log_odds(*in_texts, cfg.prior * (in_texts[2] + in_texts[3]) / max(1.0, in_words[2] + in_words[3]))
    # words crowd in texts and languages: a unit must tell the classes apart by its texts too
    good = (delta >= cfg.min_delta) & (z >= cfg.min_z) & (by_text >= cfg.min_delta)
    model = ToxicityModel(units[good], np.minimum(delta[good], cfg.max_delta), max_e=cfg.max_e)
    clean, toxic, all_clean, all_toxic = sums(model, True)[0]
    share = lambda hits, total: min(0.999, (hits.sum() + 0.5) / (total + 1))
    other = min(-1e-4, math.log((1 - share(toxic, all_toxic)) / (1 - share(clean, all_clean))))
    # lambda: the mean of exp(lambda * score) over clean words is 1
    p = np.append(clean + 1e-9, max(1.0, all_clean - clean.sum())) / max(1.0, all_clean)
    s = np.append(model.delta, other)
    lo, hi = 1e-3, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 600))).sum() < 1 else (lo, mid)
    model = replace(model, other=other, lam=max(lo, 0.05))
    rows = sample.select("text", "toxic").mapInArrow(_fit_rows(model), "toxic int, n double, top double, sum double").toPandas()
    best = (rows["top"] + np.log(np.maximum(rows["n"], 1)))[rows["toxic"] == 0]  # k is 1 so far
    size = rows["n"][rows["toxic"] == 0]
    model = replace(model, k=float(max(1e-6, min(1e3, len(size) / max(1e-9, (np.maximum(size, 1) * np.exp(-np.maximum(best, 0))).sum())))))
    rows = sample.select("text", "toxic").mapInArrow(_fit_rows(model), "toxic int, n double, top double, sum double").toPandas()
    return replace(model, weights=_logistic(rows[["top", "sum"]].to_numpy(), rows["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_words, passages: every row of docs, without any shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shape = "doc_id long, score double, n_words long, passages array<struct<first_char: long, end_char: long, log_odds: double, log_e: double>>"
    return rows.mapInArrow(_scored(model), shape)


def drop_toxic(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """docs without the rows that score limit or more, all columns as they are, whatever their names, without any shuffle."""
    at = column_at(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, f"c{at}"):
                keep = [_probability(model, top, sum_) < limit for _, top, sum_, *_ in _texts(model, part.column(f"c{at}"))]
                yield part.filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots do not pass through Arrow
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
