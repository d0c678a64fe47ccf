"""The one-dimensional tracker fold over streams whose leads come late, twice, out of order or never."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

POINTS = "forecast_case_id string, lead_hours int, held double, status string"
HOUR_MS = 3_600_000


class _Fold(StatefulProcessor):
    """State of a case: the place in the plan, the value held, whether it is kept, and the values that came before their turn."""

    def __init__(self, leads: Sequence[int], most: float, patience_ms: int):
        self.leads, self.most, self.patience = list(leads), most, patience_ms
        self.place = {lead: k for k, lead in enumerate(self.leads)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "place int, held double, ok boolean")
        self.waiting = handle.getMapState("waiting", "place int", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.at.exists()
        place, held, ok = self.at.get() if known else (0, None, True)
        due = None
        for frame in rows:
            for lead, ms, value in zip(frame["lead_hours"].tolist(), frame["at_ms"].tolist(), frame["value"].tolist(), strict=True):
                due = ms + (self.leads[-1] - lead) * HOUR_MS + self.patience
                k = self.place.get(lead, -1)
                if k >= place and not self.waiting.containsKey((k,)):
                    self.waiting.updateValue((k,), (value,))
        if not known and due is not None:
            self.handle.registerTimer(due)
        out = []
        while self.waiting.containsKey((place,)):
            (value,) = self.waiting.getValue((place,))
            self.waiting.removeKey((place,))
            ok = ok and (held is None or abs(value - held) <= self.most)
            held = value if ok else held
            out.append((key[0], self.leads[place], held, "ok" if ok else "lost"))
            place += 1
        self.at.update((place, held, ok))
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        place, held, _ = self.at.get()
        self.at.clear()
        self.waiting.clear()
        yield self._frame([(key[0], lead, held, "terminated") for lead in self.leads[place:]])

    @staticmethod
    def _frame(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["forecast_case_id", "lead_hours", "held", "status"])
        return frame.astype({"lead_hours": "int32", "held": "float64"})

    def close(self) -> None:
        pass


def hold_or_lose_planned(steps: DataFrame, leads: Sequence[int], most: float, lateness: str = "1 hour", patience_hours: float = 6.0) -> DataFrame:
    """forecast_case_id, lead_hours, held, status over a stream of (forecast_case_id, lead_hours, valid_time, value): one row a case and planned lead.

    Leads are judged in the order of the plan, whatever the order of their rows: a row that is early
    waits in the state. status is ok, or lost from the first value that differs from the one held by
    more than most. When event time has passed the case's last planned lead by patience and lateness, the
    leads from the first that is lacking on come out as terminated, with the value held, and the
    case's state is dropped; values that waited behind a gap are not used, as a track ends at its
    gap. Repeated leads count once, the first that is processed; leads outside the plan and rows
    behind the watermark are ignored, so lateness must cover how far the leads of all cases are out of
    order in the stream, the whole horizon where forecasts come at once. Rows without a value or a
    lead are left out. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass) and a streaming DataFrame.
    """
    if not leads or list(leads) != sorted(set(leads)):
        raise ValueError("leads must rise")
    s = steps.select("forecast_case_id", F.col("lead_hours").cast("int").alias("lead_hours"), F.col("valid_time").cast("timestamp").alias("valid_time"), F.col("value").cast("double").alias("value"))
    s = s.withWatermark("valid_time", lateness).where("value IS NOT NULL AND lead_hours IS NOT NULL").withColumn("at_ms", F.unix_millis("valid_time"))
    return s.groupBy("forecast_case_id").transformWithStateInPandas(_Fold(leads, most, int(patience_hours * HOUR_MS)), POINTS, "append", "eventTime")
