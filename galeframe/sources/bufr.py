"""Bulletins of BUFR messages: archives, splitting, and the reshaping of decoded arrays.

`bufr_bodies` decodes message bodies; what surrounds it, finding the
messages and turning decoded arrays into rows, is here.
"""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.operators import validation

#: Thresholds of decoded wind radii in m/s and the order of their quarters.
THRESHOLDS = (18, 26, 33)
QUARTERS = ("ne", "se", "sw", "nw")
MESSAGES = "member string, message_index int, content binary, error string"


def split(data: bytes) -> list[bytes]:
    """The messages of a bulletin: each begins with BUFR and its length in three bytes and ends in 7777; anything else raises."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"BUFR" or at + 8 > len(data):
            raise ValueError(f"no message at byte {at}")
        size = int.from_bytes(data[at + 4 : at + 7], "big")
        if size < 12 or at + size > len(data):
            raise ValueError(f"truncated message at byte {at}")
        if data[at + size - 4 : at + size] != b"7777":
            raise ValueError(f"no terminator at byte {at + size - 4}")
        out.append(data[at : at + size])
        at += size
    if not out:
        raise ValueError("empty bulletin")
    return out


def members(archive: bytes | BinaryIO, depth: int = 3) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the files of a tar archive, one at a time in the archive's order; names must have depth plain parts. A stream is read forward only."""
    stream = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    with tarfile.open(fileobj=stream, mode="r|*") as tar:
        for m in tar:
            if not m.isfile():
                continue
            parts = m.name.split("/")
            if len(parts) != depth or any(p in ("", ".", "..") for p in parts):
                raise ValueError(f"unexpected member {m.name}")
            yield m.name, tar.extractfile(m).read()


def _archives(spark: SparkSession, path: str, stream_above: int) -> DataFrame:
    """path and content of archives; those of more bytes than stream_above come without content."""
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > stream_above).select("path", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") <= stream_above).select("path", "content").unionByName(large)


def _opened(path: str, content: bytes | None) -> bytes | BinaryIO:
    if content is not None:
        return bytes(content)
    fs, at = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_stream(at, compression=None, buffer_size=1 << 20)


def read_archives(spark: SparkSession, path: str, stream_above: int = 1 << 28) -> DataFrame:
    """archive, member, message_index, content, error, message_id of all messages in the archives at path.

    An archive is walked in one task, a member at a time. Those of up to stream_above bytes come
    through Spark's file source; larger ones, of any size, are opened as streams by pyarrow's file
    systems, so that no more than a member is held. A member that does not split gives one row with
    its error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                for name, data in members(_opened(archive, content)):
                    try:
                        rows = [(archive, name, i, m, None) for i, m in enumerate(split(data))]
                    except ValueError as e:
                        rows = [(archive, name, -1, None, str(e))]
                    yield pd.DataFrame(rows, columns=["archive", "member", "message_index", "content", "error"])

    found = _archives(spark, path, stream_above).mapInPandas(run, f"archive string, {MESSAGES}")
    return found.withColumn("message_id", F.concat("member", F.lit("#"), F.col("message_index").cast("string")))


def member_inventory(spark: SparkSession, path: str, stream_above: int = 1 << 28) -> DataFrame:
    """archive, member, size_bytes, sha256, declared_init (the fourteen digits in the member's name) of every archive member; contents stay in the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"], strict=True):
                for name, data in members(_opened(archive, content)):
                    yield pd.DataFrame([(archive, name, len(data), hashlib.sha256(data).hexdigest())], columns=["archive", "member", "size_bytes", "sha256"])

    found = _archives(spark, path, stream_above).mapInPandas(run, "archive string, member string, size_bytes long, sha256 string")
    stamp = F.nullif(F.regexp_extract("member", r"_(\d{14})_[^/]*$", 1), F.lit(""))
    return found.withColumn("declared_init", F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def changed_members(inventory: DataFrame, existing: DataFrame) -> DataFrame:
    """Findings (rule, key, detail) of members that exist (member, sha256) with other content."""
    both = inventory.join(existing.select("member", F.col("sha256").alias("_was")), "member")
    return validation.check(both, F.col("sha256") == F.col("_was"), ["member"], "content_differs", F.col("sha256"))


def wrong_times(inventory: DataFrame, decoded: DataFrame) -> DataFrame:
    """Findings of members whose name holds no time, or another than one of their decoded messages (message_id, init_time)."""
    nameless = validation.check(inventory, F.col("declared_init").isNotNull(), ["member"], "time_missing_in_name")
    times = decoded.select(F.substring_index("message_id", "#", 1).alias("member"), "message_id", "init_time")
    both = times.join(inventory.where("declared_init IS NOT NULL").select("member", "declared_init"), "member")
    return validation.violations(nameless, validation.check(both, F.col("init_time") == F.col("declared_init"), ["message_id"], "time_differs", F.col("init_time")))


def decode(found: DataFrame, decoder: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that decoder makes of each message's bytes, with its message_id."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"message_id": i, **r} for i, c in zip(frame["message_id"], frame["content"], strict=True) for r in decoder(bytes(c))]
            yield pd.DataFrame(rows)

    return found.where("content IS NOT NULL").select("message_id", "content").mapInPandas(run, f"message_id string, {schema}")


def position(lat: str, lon: str) -> tuple[Column, Column]:
    """Decoded position without missing markers: latitude beyond 90 raises, longitude up to 360 either way is wrapped."""
    y, x = scalar.sentinel_to_null(lat), scalar.sentinel_to_null(lon)
    bad = F.raise_error(F.lit("position out of range")).cast("double")
    return F.when(y.isNull() | (F.abs(y) <= 90), y).otherwise(bad), F.when(x.isNull(), x).when(F.abs(x) <= 360, geo.wrap_longitude(x)).otherwise(bad)


def reshape_points(decoded: DataFrame) -> DataFrame:
    """One row a lead from parallel arrays (lead_hours, latitude, longitude, pressure_pa, wind_ms, radii_m of 12 a lead).

    Arrays of other lengths raise; leads must rise within 0..240.
    """
    n = F.size("lead_hours")
    fits = (F.size("latitude") == n) & (F.size("longitude") == n) & (F.size("pressure_pa") == n) & (F.size("wind_ms") == n) & (F.size("radii_m") == 12 * n)
    rising = (F.array_sort(F.array_distinct("lead_hours")) == F.col("lead_hours")) & F.forall("lead_hours", lambda h: h.between(0, 240))
    ok = F.when(fits & rising, F.lit(True)).otherwise(F.raise_error(F.lit("arrays of a message do not fit")).cast("boolean"))
    each = decoded.where(ok).select("*", F.posexplode("lead_hours").alias("_k", "_lead"))
    at = lambda c: F.get(c, F.col("_k"))
    each = each.withColumns({"_y": at("latitude"), "_x": at("longitude")})
    lat, lon = position("_y", "_x")
    wind = scalar.sentinel_to_null(at("wind_ms"))
    radii = [scalar.m_to_km(scalar.sentinel_to_null(F.get("radii_m", F.col("_k") * 12 + 4 * t + q))).alias(f"radius_{ms}ms_{name}_km") for t, ms in enumerate(THRESHOLDS) for q, name in enumerate(QUARTERS)]
    return each.select("message_id", F.col("_lead").alias("lead_hours"), lat.alias("latitude"), lon.alias("longitude"), scalar.pa_to_hpa(scalar.sentinel_to_null(at("pressure_pa"))).alias("pressure_hpa"), wind.alias("max_wind_ms"), scalar.ms_to_kt(wind).alias("max_wind_kt"), *radii)


def name_time(path: str) -> str | None:
    """The time in a file's name as yyyymmddhh, for comparison with the message's own."""
    found = re.search(r"(\d{10})", path.rsplit("/", 1)[-1])
    return found[1] if found else None
