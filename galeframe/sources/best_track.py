"""Best-track CSV: a header, a units row, then fixes; the literal NA is a basin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeframe.operators.validation import IntegrityError, not_null, require, require_columns, unique_key

#: Columns that a best-track table must have, and its numeric ones.
REQUIRED = ("SID", "NAME", "BASIN", "NATURE", "TRACK_TYPE", "USA_STATUS", "ISO_TIME", "LAT", "LON", "USA_WIND", "USA_PRES")
RADII = tuple(f"USA_R{kt}_{q}" for kt in (34, 50, 64) for q in ("NE", "SE", "SW", "NW"))
NUMBERS = ("LAT", "LON", "USA_WIND", "USA_PRES", *RADII)


def numbered(raw: DataFrame, name: str = "SOURCE_ROW") -> DataFrame:
    """The data rows of one CSV file with their places in it, from -1: that is the units row, 0 the first fix.

    Rows of one block of the file follow each other in one task; where a block begins follows from
    the numbers of rows in those before it, a table of one row a block.
    """
    rows = raw.select("*", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    return rows.join(blocks, "_block").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") - 1).drop("_block", "_at", "_first", "_before")


def read(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Typed fixes with TRACK_TYPE_NORMALIZED and SOURCE_ROW (0 for the first fix).

    The units row is the first behind the header and known by its place. Numbers that do not parse
    are null; with check, missing ids, times and positions and repeated (SID, ISO_TIME) raise.
    """
    raw = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    require_columns(raw, REQUIRED)
    names = raw.columns
    trimmed = numbered(raw).where("SOURCE_ROW >= 0").select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in names], "SOURCE_ROW")
    numbers = [c for c in NUMBERS if c in names]
    typed = trimmed.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in numbers})
    typed = typed.withColumn("ISO_TIME", F.try_to_timestamp("ISO_TIME").cast("timestamp_ntz")).withColumn("TRACK_TYPE_NORMALIZED", F.lower("TRACK_TYPE"))
    if check:
        require(not_null(typed, ["SID", "ISO_TIME", "LAT", "LON"], ["SOURCE_ROW"]), unique_key(typed, ["SID", "ISO_TIME"], "duplicate_fix"))
    return typed.orderBy("SID", "ISO_TIME", "SOURCE_ROW")


def select_track_types(fixes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Rows of the kinds, whatever their case; raises if none are left."""
    got = fixes.where(F.lower("TRACK_TYPE").isin(*[k.lower() for k in kinds]))
    if got.isEmpty():
        raise IntegrityError(f"no fix of the track types {', '.join(kinds)}")
    return got


def read_truth(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Fixes for verification: main track, tropical or subtropical storms, with an ATCF id, whether or not they have a SID; a bad time raises."""
    columns = ("SID", "USA_ATCF_ID", "ISO_TIME", "TRACK_TYPE", "NATURE", "LAT", "LON", "NAME")
    raw = require_columns(spark.read.option("header", True).option("nullValue", "").csv(path), columns)
    raw = numbered(raw.select(*columns, "_metadata")).where("SOURCE_ROW >= 0")
    # tied to the row's number, or the filter on times would be applied to the units row too
    when = F.when(F.col("SOURCE_ROW") >= 0, F.to_timestamp_ntz("ISO_TIME", F.lit("yyyy-MM-dd HH:mm:ss")))
    t = raw.withColumn("ISO_TIME", when).withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("LAT", "LON")})
    span = F.col("ISO_TIME").between(F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end)))
    t = t.where(span & (F.lower("TRACK_TYPE") == "main") & F.col("NATURE").isin("TS", "SS") & (F.trim("USA_ATCF_ID") != "")).withColumn("USA_ATCF_ID", F.upper(F.trim("USA_ATCF_ID"))).select(*columns)
    require(not_null(t, ["LAT", "LON"], ["USA_ATCF_ID", "ISO_TIME"]), unique_key(t, ["USA_ATCF_ID", "ISO_TIME"], "duplicate_truth"))
    return t


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalog table as text: only empty fields are null, NA stays NA."""
    return spark.read.option("header", True).option("nullValue", "").csv(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan table as text: blanks stay empty strings."""
    raw = spark.read.option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in raw.columns])
