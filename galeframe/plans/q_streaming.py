"""The streaming form of the sessions, run here as a batch so that SQL can check it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.streaming import sessions


@query("""SELECT storm_id, min(iso_time) AS episode_start, max(iso_time) AS episode_end, count(*) AS contact_rows, max(wind_kt) AS peak_kt FROM (
 SELECT *, sum(new) OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) AS g FROM (SELECT *, CASE WHEN epoch_us(iso_time) - lag(epoch_us(iso_time)) OVER (PARTITION BY storm_id ORDER BY iso_time, fix_id) > 21600000000 THEN 1 ELSE 0 END AS new FROM contacts)) GROUP BY storm_id, g""", ("contacts",))
def i01_session_windows(spark: SparkSession, d: str) -> DataFrame:
    return sessions.episodes(views.contacts(spark, d))
