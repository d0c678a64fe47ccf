"""Queries over ensemble scores (D14 to D18) with the members of the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.operators import ensemble
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.plans.views import lambert


@query("""SELECT forecast_id, round(a - b / 2, 6) AS crps FROM (SELECT forecast_id, avg(abs(value - truth)) AS a FROM members GROUP BY 1) JOIN
 (SELECT x.forecast_id, avg(abs(x.value - y.value)) AS b FROM members x JOIN members y USING (forecast_id) GROUP BY 1) USING (forecast_id)""", ("members",))
def d15_crps(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.crps(views.members(spark, d), ["forecast_id"]).select("forecast_id", F.round("crps", 6).alias("crps"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    m = views.members(spark, d)
    return m.select("forecast_id", "member", (F.lit(15.0) + F.col("value") / 20.0).alias("lat"), (F.lit(130.0) + F.col("value") / 15.0 + F.col("member") / 50.0).alias("lon"), F.lit(15.0).alias("truth_lat"), F.lit(130.0).alias("truth_lon"))


@query(f"""WITH p AS (SELECT forecast_id, member, 15e0 + value / 20e0 AS lat, 130e0 + value / 15e0 + member / 50e0 AS lon FROM members),
a AS (SELECT forecast_id, avg({lambert("lat", "lon", "15e0", "130e0")}) AS own, count(*) AS m FROM p GROUP BY 1),
b AS (SELECT x.forecast_id, sum({lambert("x.lat", "x.lon", "y.lat", "y.lon")}) AS pairs FROM p x JOIN p y ON x.forecast_id = y.forecast_id AND x.member < y.member GROUP BY 1)
SELECT forecast_id, round(own - pairs / (m * m), 6) AS energy FROM a JOIN b USING (forecast_id)""", ("members",))
def d16_energy(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.energy_score(_placed(spark, d), ["forecast_id"]).select("forecast_id", F.round("energy", 6).alias("energy"))


@query("SELECT forecast_id, round(pow(avg((value >= 5)::INTEGER::DOUBLE) - (max(truth) >= 5)::INTEGER::DOUBLE, 2), 6) AS brier FROM members GROUP BY 1", ("members",))
def d17_brier(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.brier(views.members(spark, d), ["forecast_id"], 5.0).select("forecast_id", F.round("brier", 6).alias("brier"))


@query("""SELECT forecast_id, count(*) = 64 AND min(member) = 0 AND max(member) = 63 AND count(DISTINCT member) = 64 AS complete FROM members WHERE NOT (forecast_id % 3 = 0 AND member = 7) GROUP BY 1""", ("members",))
def d18_complete(spark: SparkSession, d: str) -> DataFrame:
    m = views.members(spark, d).where("NOT (forecast_id % 3 = 0 AND member = 7)")
    return ensemble.complete(m, ["forecast_id"], 64, ["value"])


def _errors(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    return e.select((F.col("user_id") % 3).cast("long").alias("lead"), F.col("user_id").alias("storm_id"), (F.col("value") - 50.0).alias("error"))


@query()
def d14_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.bootstrap_interval(_errors(spark, d), ["lead"], "storm_id", "error", seed=20220801)


@query("""
WITH s AS (SELECT user_id % 3 AS lead, user_id AS storm, sum(abs(value - 50)) AS s, count(*) AS n FROM events GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY storm) - 1 AS slot, count(*) OVER (PARTITION BY lead) AS m FROM s),
p AS (SELECT lead, k AS draw, ((k * 7919 + slot * 104729 + 1) * 48271 % 2147483647) * 48271 % 2147483647 % m AS slot FROM t, (SELECT unnest(range(0, 200)) AS k)),
r AS (SELECT p.lead, draw, sum(s) / sum(n) AS mae FROM p JOIN t ON t.lead = p.lead AND t.slot = p.slot GROUP BY ALL)
SELECT lead::BIGINT AS lead, round(quantile_cont(mae, 0.025), 6) AS low, round(quantile_cont(mae, 0.975), 6) AS high FROM r GROUP BY lead""")
def d14_bootstrap_by_formula(spark: SparkSession, d: str) -> DataFrame:
    b = ensemble.bootstrap_by_formula(_errors(spark, d), ["lead"], "storm_id", "error")
    return b.select("lead", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
