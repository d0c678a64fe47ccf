"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions only.

Rows get global numbers 0 .. n-1, a seeded permutation maps each number to a place, and the place
gives shard = place % shards and slot = place // shards. Shard sizes differ by one row at most,
slots have no gaps, and any row's shard and slot follow from its number, n and the seed alone.

The permutation is an alternating Feistel network over the grid a x b, a = ceil(sqrt(n)),
b = ceil(n / a), the smallest such grid; places n and above (fewer than a) walk on through the
network until they fall below n. The longest walk is found exactly, by walking on from all places
above n - 1 that a row can come to, so the expression that permutes has the steps every row needs.

Edge cases: equal rows share one entry and its range of numbers, which is spelled out in chunks, so
hot rows need no task or long array of their own; null values take part like others; an empty table
gives an empty result; columns of the rows may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from galeframe.llm.common import counted_up, named, stored

ROUNDS = 6


def _sides(rows: int) -> tuple[int, int]:
    a = math.isqrt(max(rows, 1) - 1) + 1
    return a, -(-rows // a)


def _permuted(place: Column, rows: int, seed: int) -> Column:
    """One pass of the network over 0 .. a*b-1."""
    a, b = _sides(rows)
    start = F.struct(F.floor(place / F.lit(b)).cast("long").alias("l"), F.pmod(place, F.lit(b)).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        l = F.when(even, F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed)), F.lit(a)), F.lit(a))).otherwise(s["l"])  # noqa: E741
        r = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], i, F.lit(seed)), F.lit(b)), F.lit(b)))
        return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * b + s["r"])


def walk_steps(spark: SparkSession, rows: int, seed: int) -> int:
    """Passes of the network that the longest walk from a row's number needs.

    Walks enter the places above at those that no other place above leads to, and from there they
    come back below; cycles that lie wholly above are never entered.
    """
    a, b = _sides(rows)
    above = spark.range(rows, a * b).select(F.col("id").alias("p"))
    steps, now = 1, above.join(above.select(_permuted(F.col("p"), rows, seed).alias("p")), "p", "left_anti")
    while now.limit(1).count():
        now = stored(now.select(_permuted(F.col("p"), rows, seed).alias("p")).where(F.col("p") >= rows))
        steps += 1
    return steps


def place_of(number: Column, rows: int, seed: int, steps: int) -> Column:
    """The permuted place of a row number below rows."""
    walk = lambda p, i: F.when((i == 0) | (p >= rows), _permuted(p, rows, seed)).otherwise(p)
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), number.cast("long"), walk)


def numbered(df: DataFrame, bucket_rows: int = 100_000) -> DataFrame:
    """Equal rows of df once each, with `copies`, their number, and `first`, the first of their row numbers.

    Row numbers follow hash buckets of about bucket_rows distinct rows, and the columns' order
    within a bucket; the buckets' totals, one row each, are summed up in one small window.
    """
    columns = df.columns
    held = stored(df.groupBy(*columns).agg(F.count("*").alias("copies")))
    buckets = max(1, math.ceil(held.count() / bucket_rows))
    held = held.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy("bucket").orderBy(*columns)
    total = held.groupBy("bucket").agg(F.sum("copies").alias("n"))
    before = total.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = held.withColumn("within", F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    return ranked.join(before, "bucket").withColumn("first", F.col("before") + F.col("within")).drop("bucket", "before", "within")


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def _without_maps(value: Column, kind: DataType) -> Column:
    """value with its maps as arrays of entries, which can be hashed, ordered and grouped; _with_maps() undoes it."""
    if not _has_map(kind):
        return value
    if isinstance(kind, MapType):
        return F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _without_maps(e["value"], kind.valueType).alias("value")))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda e: _without_maps(e, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*(_without_maps(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))


def _with_maps(value: Column, kind: DataType) -> Column:
    if not _has_map(kind):
        return value
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(value, lambda e: F.struct(e["key"].alias("key"), _with_maps(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda e: _with_maps(e, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*(_with_maps(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))


def shard_rows(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """df with `shard` and `slot`; these win over columns of df by the same names, which are dropped."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = df.count()
    if not rows:
        return df.select(*[named(c) for c in kept], F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    steps = walk_steps(df.sparkSession, rows, seed)
    plain = [f"c{k}" for k in range(len(df.columns))]
    kinds = [f.dataType for f in df.schema.fields]
    flat = df.toDF(*plain).select(*(_without_maps(F.col(p), t).alias(p) for p, t in zip(plain, kinds, strict=True)))
    many = counted_up(numbered(flat), "first", "copies", "number")
    placed = many.withColumn("place", place_of(F.col("number"), rows, seed, steps))
    own = [_with_maps(F.col(p), t).alias(c) for p, c, t in zip(plain, df.columns, kinds, strict=True) if c in kept]
    return placed.select(*own, F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order within each file."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
