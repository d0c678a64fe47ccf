"""Duplicate rows and duplicate forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, rows: keys of more rows than one."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def signatures(points: DataFrame, message_id: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """message_id, signature, conflict, points: a digest of a message's distinct rows in any order, and whether two of them share order columns but differ.

    Each row is hashed first, so that what is gathered for a message is one short hash a row. Keys are
    counted by groups of a message and its order columns: where points lie by message_id already
    (repartition), no step shuffles them again.
    """
    rows = points.select(message_id, *order, *values).distinct()
    row = F.sha2(F.to_json(F.struct(*order, *values), {"ignoreNullFields": "false"}), 256)
    keyed = rows.withColumn("_h", row).groupBy(message_id, *order).agg(F.collect_list("_h").alias("_h"), F.count("*").alias("_n"))
    out = keyed.groupBy(message_id).agg(F.sha2(F.array_join(F.array_sort(F.flatten(F.collect_list("_h"))), ""), 256).alias("signature"), F.sum("_n").alias("points"), F.count("*").alias("keys"))
    return out.select(message_id, "signature", (F.col("points") > F.col("keys")).alias("conflict"), F.col("points").cast("long").alias("points"))


def reconcile(messages: DataFrame, keys: Sequence[str], message_id: str = "message_id") -> DataFrame:
    """messages (with signature, conflict) with duplicate_status and canonical_message_id.

    Groups of equal signatures keep the smallest message_id as canonical, the rest are equivalent
    duplicates; a group with a conflict or with different signatures is rejected whole.
    """
    w = Window.partitionBy(*keys)
    m = messages.withColumns({"_n": F.count("*").over(w), "_lo": F.min(F.coalesce("signature", F.lit(""))).over(w), "_hi": F.max(F.coalesce("signature", F.lit(""))).over(w), "_bad": F.max(F.coalesce("conflict", F.lit(False))).over(w), "_first": F.min(message_id).over(w)})
    rejected = F.col("_bad") | (F.col("_lo") != F.col("_hi"))
    status = F.when(rejected, "conflicting_duplicate_forecasts").when(F.col("_n") == 1, "unique").when(F.col(message_id) == F.col("_first"), "unique").otherwise("equivalent_duplicate")
    return m.withColumns({"duplicate_status": status, "canonical_message_id": F.when(~rejected, F.col("_first"))}).drop("_n", "_lo", "_hi", "_bad", "_first")
