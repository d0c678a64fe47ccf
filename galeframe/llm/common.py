"""What several operators share: the shared folder, materialised tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


Store = Callable[[DataFrame], DataFrame]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir as the cluster sets it.

    Where it is unset, a folder in the warehouse, which they share too, is made the session's
    checkpoint folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return (named or spark.sparkContext.getCheckpointDir()).rstrip("/")


def _put(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts the lineage.

    Unlike checkpoint() the table is columnar and compressed, so later reads can prune columns. The
    folder stays until the cluster cleans its checkpoint folder.
    """
    spark = df.sparkSession
    return _put(df, f"{shared_dir(spark)}/galeframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Store]:
    """Gives a function like stored() whose tables are deleted at the end of the block."""
    folder = f"{shared_dir(spark)}/galeframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    try:
        yield lambda df: _put(df, f"{folder}/{uuid.uuid4().hex}")
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint; its files go when the frame is unused if spark.cleaner.referenceTracking.cleanCheckpoints is set, else with the folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most max_bytes of text each, or one row if that row is longer."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def named(column: str) -> Column:
    """The column by exactly this name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def column_at(df: DataFrame, name: str) -> int:
    """Position of the column by this name, its spelling first, else in any case of letters."""
    names = df.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name.lower())


def with_made(df: DataFrame, read: str, made: str, kind: str, run: Callable) -> DataFrame:
    """df with a column `made` of type kind in place of any by that name in any case of letters.

    run is a function for mapInArrow whose batches hold read's values as column read; it adds a last
    column, made (see added()). All columns go through it under stand-in names, so they may have any
    name and occur twice.
    """
    at, names = column_at(df, read), df.columns
    kept = [k for k, c in enumerate(names) if c.lower() != made.lower()]
    plain = df.toDF(*("read" if k == at else f"c{k}" for k in range(len(names))))
    rows = plain.select(*(plain.columns[k] for k in range(len(names)) if k in kept or k == at))
    schema = rows.limit(0).withColumn("made", F.lit(None).cast(kind)).schema
    return rows.mapInArrow(run, schema).select(*(plain.columns[k] for k in kept), "made").toDF(*(names[k] for k in kept), made)


def added(part: pa.RecordBatch, made: pa.Array) -> pa.RecordBatch:
    """A batch with the column that a function of with_made() makes."""
    return pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, "made"])


def repeated(rows: DataFrame, times: str, chunk: int = 1024) -> DataFrame:
    """rows, each as often as its column times says, without that column; a row's repeats are made in chunks, so no long array is ever held."""
    columns = [named(c) for c in rows.columns if c != times]
    held = rows.where(F.col(times) > 0).select(F.struct(*columns).alias("row"), F.col(times).cast("long").alias("n"))
    held = held.select("row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("c"))
    held = held.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(chunk), F.col("n") - F.col("c") * chunk))))
    return held.select("row.*")


def counted_up(rows: DataFrame, first: str, count: str, name: str, chunk: int = 1024) -> DataFrame:
    """rows once for each number first, first + 1 .. first + count - 1, as column name; the numbers are made in chunks, so no long array is ever held."""
    at = f"{name}_chunk"
    held = rows.withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / chunk))))
    start = F.col(first) + F.col(at) * chunk
    return held.withColumn(name, F.explode(F.sequence(start, F.least(F.col(first) + F.col(count), start + chunk) - 1))).drop(at)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph; component is the smallest node reachable.

    edges: two columns of one orderable type, in any direction; loops, repeats and nulls are fine.
    Alternates large-star and small-star contractions until the edges stay the same. Each is an
    aggregation with map-side combining and one equi-join, so a node with a third of all edges
    neither needs one task nor reaches the driver. Only a count and a checksum are collected.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = checkpointed(e.where("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        now = mark(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
