"""Results by case with a fingerprint: what to run again, and provenance records."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from galeframe.operators.validation import IntegrityError


def fingerprint(**parts: object) -> str:
    """SHA-256 of a run's inputs, parameters and selection, the same for the same values in any order."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str, allow_nan=False).encode()).hexdigest()


def case_fingerprints(cases: DataFrame, inputs: DataFrame, keys: Sequence[str], run: str) -> DataFrame:
    """cases with fingerprint: of their own row, the run's mark, and the identity (path, size, time of change) of the files that hold their input rows.

    Only the keys and the files' metadata are read of inputs; a case without input rows has a
    fingerprint too.
    """
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = inputs.select(*keys, file.alias("_f")).distinct().groupBy(*keys).agg(F.bit_xor("_f").alias("_f"), F.count("*").alias("_n"))
    row = F.to_json(F.struct(*[F.col(c) for c in cases.columns]), {"ignoreNullFields": "false"})
    with_row = cases.withColumn("_row", row).join(files, list(keys), "left")
    return with_row.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.lit(run), "_row", F.coalesce("_f", F.lit(0)), F.coalesce("_n", F.lit(0))), 256)).drop("_row", "_f", "_n")


def require_same_inputs(cases: DataFrame, done: DataFrame, keys: Sequence[str]) -> None:
    """Raise before any write if a stored result that is not an input error belongs to other inputs of its case."""
    good = done.where("case_status <> 'input_error'").select(*keys, F.col("fingerprint").alias("_was")).distinct()
    other = cases.join(good, list(keys)).where("fingerprint <> _was").limit(5).collect()
    if other:
        raise IntegrityError("stored results belong to other inputs: " + ", ".join("/".join(str(r[k]) for k in keys) for r in other))


def pending(cases: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cases without a stored result of their fingerprint; stored input errors count as not done."""
    good = done.where("case_status <> 'input_error'").select(*keys, "fingerprint").distinct()
    return cases.join(good, [*keys, "fingerprint"], "left_anti")


def stored_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The results at path, or none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def require_same_run(stored: str | None, current: str) -> None:
    """Raise before any write if a folder belongs to a run with another fingerprint."""
    if stored is not None and stored != current:
        raise IntegrityError("the folder holds results of a run with other inputs or parameters")


def store(results: DataFrame, path: str, by: Sequence[str] = ("model",)) -> None:
    """Append results, one folder a key; Spark's commit makes each append whole or absent."""
    results.write.mode("append").partitionBy(*by).parquet(path)


def latest(results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row of each key, after cases were run again."""
    others = [c for c in results.columns if c not in keys]
    newest = results.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in others if c != order])).alias("_m"))
    return newest.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in others])
