"""Contact episodes and tracker steps over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def episodes(contacts: DataFrame, lateness: str = "1 hour", gap: str = "6 hours") -> DataFrame:
    """storm_id, episode_start, episode_end, contact_rows, peak_kt of a stream of contacts (storm_id, iso_time, wind_kt).

    A session closes when the watermark has passed its end by the gap; rows later than lateness are
    dropped. In batch it gives the same episodes at once.
    """
    c = contacts.withColumn("iso_time", F.col("iso_time").cast("timestamp")).withWatermark("iso_time", lateness)
    s = c.groupBy("storm_id", F.session_window("iso_time", gap).alias("w")).agg(F.min("iso_time").alias("episode_start"), F.max("iso_time").alias("episode_end"), F.count("*").alias("contact_rows"), F.max("wind_kt").alias("peak_kt"))
    return s.select("storm_id", F.col("episode_start").cast("timestamp_ntz").alias("episode_start"), F.col("episode_end").cast("timestamp_ntz").alias("episode_end"), "contact_rows", "peak_kt")


def hold_or_lose(steps: DataFrame, most: float) -> DataFrame:
    """The one-dimensional tracker fold over a stream of (storm_id, step, value): storm_id, step, held, status.

    State is the last value kept and whether the track is lost. Steps of a storm must come in order
    across micro-batches; within one they are sorted.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ok = state.get if state.exists else (None, True)
        rows = []
        for _, r in pd.concat(list(frames)).sort_values("step", kind="stable").iterrows():
            if held is None:
                held = float(r["value"])
            else:
                ok = ok and abs(float(r["value"]) - held) <= most
                held = float(r["value"]) if ok else held
            rows.append((key[0], int(r["step"]), held, "ok" if ok else "lost"))
        state.update((held, ok))
        yield pd.DataFrame(rows, columns=["storm_id", "step", "held", "status"])

    return steps.groupBy("storm_id").applyInPandasWithState(run, "storm_id long, step int, held double, status string", "held double, ok boolean", "append", GroupStateTimeout.NoTimeout)
