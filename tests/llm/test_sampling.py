"""Sharding and mixing."""

import itertools
import math
import random

import xxhash
from pyspark.sql import functions as F

from galeframe.llm import mixing, sharding


def h(*values):
    seed = 42
    for v, size in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(size, "little", signed=True), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def permute(p, rows, seed):
    a = math.isqrt(max(rows, 1) - 1) + 1
    b = -(-rows // a)
    while True:
        left, right = divmod(p, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + h((right, 8), (i, 4), (seed, 4)) % a) % a
            else:
                right = (right + h((left, 8), (i, 4), (seed, 4)) % b) % b
        p = left * b + right
        if p < rows:
            return p


def test_permutation_equals_plain_python(spark):
    for rows in (1, 2, 3, 10, 97, 1000):
        steps = sharding.walk_steps(spark, rows, 5)
        got = [r.p for r in spark.range(rows).orderBy("id").select(sharding.place_of(F.col("id"), rows, 5, steps).alias("p")).collect()]
        assert sorted(got) == list(range(rows)) and got == [permute(i, rows, 5) for i in range(rows)]


def test_shards_are_even_and_repeatable(spark):
    rows = [(i % 700, "x" * (i % 13)) for i in range(1500)] + [(None, None)] * 40 + [(9, "hot")] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_rows(df, 8, seed=3).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(a), str(b)) for a, b in rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 8, len(rows) // 8 + 1)
    again = sharding.shard_rows(df.repartition(5).orderBy("text"), 8, seed=3).collect()
    key = lambda rs: sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in rs)
    assert key(got) == key(again) != key(sharding.shard_rows(df, 8, seed=4).collect())
    assert sharding.shard_rows(df.limit(0), 8).collect() == []


def test_numbers_are_global_in_many_buckets(spark):
    df = spark.createDataFrame([(i % 50,) for i in range(400)], "a long")
    got = sharding.numbered(df, bucket_rows=7).collect()
    numbers = [r["first"] + k for r in got for k in range(r.copies)]
    assert sorted(numbers) == list(range(400))


def fill(sizes, total, weights=(5, 2, 1), limit=3):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped = {}
    while True:
        rest = total - sum(capped.values())
        share = sum(w[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and rest * w[s] / share > limit * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, rest * w[s] / share if share else 0) for s in names}
        capped |= {s: limit * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * (1 + j % 3) for j in range(rng.randrange(60))), rng.choice(["a", "a", "a", "a", "b", "B", "é", "z", None])) for i in range(900)]
    rows += [(1000, None, "b"), (1001, "", "only-empty"), (None, "x y", "z"), (5, "p q r", "a")] + [(2000, "same words here", "b")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"copies": F.lit(1), "passes": F.lit(1), "h": F.lit(0)})
    sizes = mixing.sized(df)
    got = mixing.allotment(sizes, seed=1).collect()
    total = sum(r.size for r in got)
    assert len(got) == len(rows) and total == sum(len((t or "").split()) for _, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    want = fill({s: sum(r.size for r in rs) for s, rs in by.items()}, total)
    for s, rs in by.items():
        assert abs(rs[0].target - want[s]) < 1e-6 and all(0 <= r.times <= 3 for r in rs)
        assert abs(sum(r.size * r.times for r in rs) - want[s]) <= 1
        assert all(r.times == 0 for r in rs if r.size == 0)
    key = lambda rs: sorted((str(r.doc_id), str(r.source), r.size, r.times) for r in rs)
    assert key(got) == key(mixing.allotment(sizes.repartition(3), seed=1, range_docs=3).collect())
    mix = mixing.mixed(df, seed=1)
    assert mix.columns == df.columns and mix.count() == sum(r.times for r in got)
    taken = {}
    for r in mix.collect():
        taken[r.doc_id, r.source, r.text] = taken.get((r.doc_id, r.source, r.text), 0) + 1
    assert 0 < taken[2000, "b", "same words here"] <= 90 and (1000, "b", None) not in taken
    odd = df.withColumns({c: F.lit(7) for c in ("mix_size", "mix_k", "mix_times", "mix_id", "s", "n", "row", "times", "tied", "docs", "extra", "cut_h", "json", "target", "size")})
    assert sorted(map(str, mixing.mixed(odd, seed=1).select(*df.columns).collect())) == sorted(map(str, mix.collect()))
    assert mixing.mixed(odd, seed=1).where("mix_size <> 7 OR n <> 7 OR row <> 7").isEmpty() and mixing.mixed(odd).columns == odd.columns
    assert mixing.allotment(sizes.limit(0)).collect() == [] and mixing.mixed(df.limit(0)).collect() == []


def nearest(lengths, counts, budget):
    """Distance of the nearest sum from budget, by the set of all sums."""
    reach = 1
    for n, c in zip(lengths, counts, strict=True):
        for _ in range(c):
            reach |= reach << n
    below = (reach & (2 << budget) - 1).bit_length() - 1
    above = reach >> budget + 1
    return min(budget - below, (above & -above).bit_length() or 1 << 62)


def check_fit(lengths, counts, budget):
    got = mixing.fit_counts(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(got, counts, strict=True))
    assert abs(sum(n * t for n, t in zip(lengths, got, strict=True)) - budget) == nearest(lengths, counts, budget)


def test_budget_fit_equals_brute_force():
    rng = random.Random(6)
    for _ in range(400):
        lengths = rng.sample(range(1, 30), 4)
        counts = [rng.randrange(1, 4) for _ in lengths]
        check_fit(lengths, counts, rng.randrange(0, sum(n * c for n, c in zip(lengths, counts, strict=True)) + 5))
    for _ in range(60):
        lengths = rng.sample(range(1, 20_000), rng.randrange(1, 6))
        counts = [rng.choice([1, 2, 9, 40]) for _ in lengths]
        check_fit(lengths, counts, rng.randrange(0, sum(n * c for n, c in zip(lengths, counts, strict=True))))
    for budget in (100_003, 180_007, 299_999):
        check_fit([9000, 9001, 20_011], [50] * 3, budget)
    many = list(range(1, 20_000, 7))
    got = mixing.fit_counts(many, [1000] * len(many), 12_345_678_901)
    assert sum(n * t for n, t in zip(many, got, strict=True)) == 12_345_678_901
