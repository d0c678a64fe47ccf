"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is cut into whole passes over the source and a remaining budget below its size.
For the budget the source's documents are counted by exact length; each length gives its even share,
and a bounded-knapsack dynamic programme over exchanges around it (a bit set of reachable sums) finds
the sum that lies nearest to the budget, on either side. Each length's documents are then taken in
the order of a seeded hash of their ids.

What a row is taken follows from its source, length and id and from one small row for each source
and length, so texts stay where they lie; that small table is broadcast up to MOST_BROADCAST rows (a
hundred bytes each) and joined by shuffle beyond.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own, last
in order; equal rows, and rows that share doc_id, source and length, share their repeats out among
themselves, in the order of the rows as JSON; empty tables give empty results. Columns besides
doc_id, source and text pass through mixed() whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.common import named, repeated, stored

WORD = r"[^\x20\x09-\x0D]+"
MOST_BROADCAST = 1_000_000
RANGE_DOCS = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words in the text."""
    return docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """source, source_size, target: one row a source.

    Weights repeat over the sources in code point order. A target is min(limit * size, level *
    weight), and the level makes the targets add up to all sizes; with the sources sorted by
    limit * size / weight, those before the level are at their limit.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    one = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * limit)
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, since = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(since)
    ratio = F.col("most") / F.col("weight")
    levels = one.withColumn("level", level).withColumn("first_open", F.when(ratio >= F.col("level"), F.struct(ratio.alias("ratio"), F.col("level"))))
    chosen = levels.withColumn("at", F.coalesce(F.min("first_open").over(everything)["level"], F.max("level").over(everything)))
    return chosen.select("source", "source_size", F.least("most", F.col("at") * F.col("weight")).alias("target"))


def _exchange(items: Sequence[tuple[int, int]], target: int, margin: int) -> list[int] | None:
    """How often to use each (length, most) so that the sum is nearest to target, less than margin away; None if no sum is."""
    mask, reach, stages = (1 << target + margin) - 1, 1, []
    for k, (n, most) in enumerate(items):
        free, part = min(most, (target + margin) // n), 1
        while free > 0 and not reach >> target & 1:
            use = min(part, free)
            stages.append((k, use, reach))
            reach |= reach << use * n & mask
            free, part = free - use, part * 2
    at = (reach & (2 << target) - 1).bit_length() - 1
    above = reach >> target + 1
    if above:
        up = target + (above & -above).bit_length()
        at = up if up - target < target - at else at
    if abs(at - target) >= margin:
        return None
    out = [0] * len(items)
    for k, use, was in reversed(stages):
        if not was >> at & 1:
            out[k] += use
            at -= use * items[k][0]
    return out


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length, at most counts[i] of lengths[i], so that the sum is nearest to budget.

    Starts from even shares and looks for the best exchange: some documents given back, others
    added. Rounds allow ever more exchanges and end with a proof: the sum misses the budget by no
    more than the lengths' common divisor forces, or all documents take part, or every length may
    change by four times the longest one. The last suffices because an exchange can be ordered so
    that its running sum stays within four times the longest length; where a running sum comes
    twice, what lies between changes nothing and can be left out.
    """
    rising = sorted((i for i in range(len(lengths)) if lengths[i] > 0 and counts[i] > 0), key=lambda i: lengths[i])
    total = sum(lengths[i] * counts[i] for i in rising)
    share = min(max(budget, 0), total)
    taken = [c * share // total if n > 0 and total else 0 for n, c in zip(lengths, counts, strict=True)]
    gap = share - sum(lengths[i] * taken[i] for i in rising)
    for i in reversed(rising):
        more = min(counts[i] - taken[i], gap // lengths[i])
        taken[i] += more
        gap -= more * lengths[i]
    if not gap:
        return taken
    divisor, longest = math.gcd(*(lengths[i] for i in rising)), lengths[rising[-1]]
    least = min(share % divisor, divisor - share % divisor)
    room, each = 1 << 14, 2
    while abs(gap) > least:
        chosen, spread = [], 0
        for i in rising:
            if spread > room:
                break
            chosen.append(i)
            spread += min(taken[i], each) * lengths[i]
        back = [min(taken[i], each) for i in chosen]
        best = _exchange([(lengths[i], b + min(counts[i] - taken[i], each)) for i, b in zip(chosen, back, strict=True)], max(0, gap + spread), abs(gap))
        everything = len(chosen) == len(rising) and all(taken[i] <= each and counts[i] - taken[i] <= each for i in rising)
        if best:
            for i, b, n in zip(chosen, back, best, strict=True):
                taken[i] += n - b
            gap = share - sum(lengths[i] * taken[i] for i in rising)
        if everything or len(chosen) == len(rising) and each >= 4 * longest:
            break
        room, each = room * 8, each * 4
    return taken


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size", kind="stable")
    size, many = int(group["source_size"].iloc[0]), group["docs"].tolist()
    want = int(math.floor(group["target"].iloc[0] + 0.5))
    passes = min(want // size, 1 << 30) if size else 0
    more = fit_counts(group["size"].tolist(), many, want - passes * size) if size else [0] * len(many)
    return pd.DataFrame({"source": group["source"], "size": group["size"], "docs": group["docs"], "source_size": size, "target": group["target"], "passes": passes, "extra": more})



def _met(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """rows (source, size, ...) with the columns of their row of table (s, n, ...)."""
    return rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))).drop("s", "n")


def _hash(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)


def allotments(sizes: DataFrame, seed: int = 0, weights: Sequence[float] = (5, 2, 1), limit: float = 3.0, range_docs: int = RANGE_DOCS) -> tuple[DataFrame, bool]:
    """A row for each source and length (s, n): source_size, target, passes, extra, docs and, where only some documents are taken once more, the last of them; and whether the table may be broadcast.

    extra documents of a length are taken once more, in the order of their hashes: those before
    (cut_h, cut_id), and cut_take of the rows at it. The cut is found without sorting a length
    whole: ranges of hashes of about range_docs documents are counted, and only the range that holds
    the cut is ranked. The number of ranges changes no result.
    """
    counts = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("docs")))
    aim = stored(targets(counts.select("source", (F.col("size") * F.col("docs")).alias("size")), weights, limit))
    to_fit = counts.join(aim.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "docs", "source_size", "target")
    fitted = to_fit.groupBy("source").applyInPandas(_fit, "source string, size long, docs long, source_size long, target double, passes long, extra long")
    fitted = stored(fitted.withColumnsRenamed({"source": "s", "size": "n"}))
    small = fitted.count() <= MOST_BROADCAST
    bits = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("docs") / range_docs)))).cast("int")
    some = fitted.where("extra > 0 AND extra < docs").select("s", "n", "extra", (63 - bits).alias("shift"))
    hashed = _met(sizes.withColumn("h", _hash(seed)), some, small).withColumn("part", F.expr("shiftrightunsigned(h, shift)"))
    ranges = hashed.groupBy("source", "size", "part").agg(F.count("*").alias("here"))
    up = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("here").over(up), F.lit(0)))
    on = _met(ranges, some, small).where("before < extra AND extra <= before + here").select(F.col("source").alias("s"), F.col("size").alias("n"), F.col("part").alias("p"), "before")
    near = _met(hashed, stored(on), small).where("part = p").groupBy("source", "size", "h", "doc_id").agg(F.count("*").alias("copies"), F.first("extra").alias("extra"), F.first("before").alias("before"))
    rank = Window.partitionBy("source", "size").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.col("before") + F.coalesce(F.sum("copies").over(rank), F.lit(0))).where("before < extra AND extra <= before + copies")
    cuts = near.select(F.col("source").alias("cs"), F.col("size").alias("cn"), F.col("h").alias("cut_h"), F.col("doc_id").alias("cut_id"), (F.col("extra") - F.col("before")).alias("cut_take"), F.col("copies").alias("cut_copies"))
    return stored(fitted.join(cuts, F.col("s").eqNullSafe(F.col("cs")) & (F.col("n") == F.col("cn")), "left").drop("cs", "cn")), small


def _times(seed: int) -> tuple[Column, Column]:
    """How often a row that has met its allotment is taken, and whether it lies at a cut that goes through equal rows."""
    h, doc, cut = _hash(seed), F.col("doc_id"), F.col("cut_id")
    at = (h == F.col("cut_h")) & doc.eqNullSafe(cut)
    before = (h < F.col("cut_h")) | ((h == F.col("cut_h")) & F.coalesce(doc < cut, doc.isNull() & cut.isNotNull()))
    more = (F.col("extra") > 0) & (F.col("cut_h").isNull() | before | at)
    times = F.when(F.col("size") > 0, F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(F.lit(0).cast("long"))
    return times, F.coalesce(at & (F.col("size") > 0) & (F.col("cut_take") < F.col("cut_copies")), F.lit(False))


def allotment(sizes: DataFrame, seed: int = 0, weights: Sequence[float] = (5, 2, 1), limit: float = 3.0, range_docs: int = RANGE_DOCS) -> DataFrame:
    """One row per row of sizes (doc_id, source, size): source_size, target, and times, how often the mix takes it."""
    plan, small = allotments(sizes, seed, weights, limit, range_docs)
    times, tied = _times(seed)
    columns = ["doc_id", "source", "size", "source_size", "target", "times"]
    rows = _met(sizes.select("doc_id", "source", "size"), plan, small).withColumns({"times": times, "tied": tied})
    equal = rows.where("tied").groupBy(*columns, "cut_take").agg(F.count("*").alias("copies"))
    part = lambda n, t: F.struct(n.alias("n"), t.alias("t"))
    equal = equal.withColumn("x", F.explode(F.array(part(F.col("cut_take"), F.col("times")), part(F.col("copies") - F.col("cut_take"), F.col("times") - 1))))
    equal = repeated(equal.select("doc_id", "source", "size", "source_size", "target", F.col("x.t").alias("times"), "x.n"), "n")
    return rows.where("NOT tied").select(*columns).unionByName(equal.select(*columns))


def mixed(docs: DataFrame, seed: int = 0, weights: Sequence[float] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """The mix itself: docs' rows, each as often as the mix takes it. Only rows at a cut through equal ids are shuffled."""
    plan, small = allotments(stored(sized(docs)), seed, weights, limit)
    times, tied = _times(seed)
    row = F.struct(*[named(c) for c in docs.columns])
    rows = _met(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), row.alias("row")), plan, small)
    rows = rows.withColumns({"times": times, "tied": tied})
    equal = rows.where("tied").groupBy("doc_id", "source", "size", "times", "cut_take", F.to_json("row").alias("json")).agg(F.first("row").alias("row"), F.count("*").alias("copies"))
    order = Window.partitionBy("doc_id", "source", "size").orderBy("json").rowsBetween(Window.unboundedPreceding, -1)
    more = F.greatest(F.lit(0), F.least("copies", F.col("cut_take") - F.coalesce(F.sum("copies").over(order), F.lit(0))))
    equal = equal.select("row", (F.col("copies") * (F.col("times") - 1) + more).alias("times"))
    return repeated(rows.where("NOT tied").select("row", "times").unionByName(equal), "times").select("row.*")
