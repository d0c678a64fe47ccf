"""Scores of ensemble forecasts, and intervals by resampling storms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import geo, scalar
from galeframe.operators.lineage import merged


def crps(members: DataFrame, keys: Sequence[str], value: str = "value", truth: str = "truth", member: str = "member") -> DataFrame:
    """keys, crps: mean |x - y| less half the mean |x_i - x_j| over all pairs, each member with itself included.

    The second term is taken from the sorted members, 2 * sum((2i - m - 1) x_i) / m**2, so no pairs
    are made.
    """
    w = Window.partitionBy(*keys).orderBy(value, member)
    ranked = members.withColumns({"_i": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy(*keys))})
    spread = F.sum((F.col("_i") * 2 - F.col("_m") - 1) * F.col(value)) * 2.0 / F.pow(F.first("_m"), F.lit(2))
    return ranked.groupBy(*keys).agg((F.avg(F.abs(F.col(value) - F.col(truth))) - spread / 2.0).alias("crps"))


def brier(members: DataFrame, keys: Sequence[str], limit: float, value: str = "value", truth: str = "truth") -> DataFrame:
    """keys, brier: the squared difference of the members' share at limit or above and whether the truth is."""
    return members.groupBy(*keys).agg(F.pow(F.avg(scalar.exceeds(value, limit)) - F.first(scalar.exceeds(truth, limit)), F.lit(2)).alias("brier"))


def complete(members: DataFrame, keys: Sequence[str], size: int, values: Sequence[str], member: str = "member") -> DataFrame:
    """keys, complete: the members are exactly 0 .. size-1 and every value is finite."""
    bad = F.lit(False)
    for v in values:
        bad = bad | scalar.finite(v).isNull()
    return members.groupBy(*keys).agg(((F.count("*") == size) & (F.countDistinct(member) == size) & (F.min(member) == 0) & (F.max(member) == size - 1) & (F.count_if(bad) == 0)).alias("complete"))


def energy_score(members: DataFrame, keys: Sequence[str], lat: str = "lat", lon: str = "lon", truth_lat: str = "truth_lat", truth_lon: str = "truth_lon", member: str = "member") -> DataFrame:
    """keys, energy: mean distance from the truth less half the mean distance over all pairs of members.

    Pairs are made within a forecast, whose members are a fixed few (50), and each once.
    """
    one = members.select(*keys, F.col(member).alias("_i"), F.col(lat).alias("_a"), F.col(lon).alias("_o"))
    two = members.select(*keys, F.col(member).alias("_j"), F.col(lat).alias("_b"), F.col(lon).alias("_p"))
    pairs = one.join(merged(two), list(keys)).where("_i < _j").withColumn("_d", geo.distance_km("_a", "_o", "_b", "_p"))
    between = pairs.groupBy(*keys).agg(F.sum("_d").alias("_pairs"))
    own = members.groupBy(*keys).agg(F.avg(geo.distance_km(lat, lon, truth_lat, truth_lon)).alias("_own"), F.count("*").alias("_m"))
    out = own.join(merged(between), list(keys), "left")
    return out.select(*keys, (F.col("_own") - F.coalesce("_pairs", F.lit(0.0)) / (F.col("_m") * F.col("_m"))).alias("energy"))


def verification_summary(cases: DataFrame, keys: Sequence[str], error: str = "error", bias: str = "bias", scores: Sequence[str] = ("crps", "brier", "energy")) -> DataFrame:
    """eligible counts all rows, matched those with an error; averages run over what is present, scores over complete ensembles, whose scores alone are not null."""
    return cases.groupBy(*keys).agg(
        F.count("*").alias("eligible"), F.count(error).alias("matched"), F.countDistinct(F.when(F.col(error).isNotNull(), F.col("storm_id"))).alias("storms"),
        F.avg(F.abs(error)).alias("mae"), F.median(F.abs(error)).alias("median_error"), F.avg(bias).alias("mean_bias"), *[F.avg(s).alias(f"mean_{s}") for s in scores],
    )


def bootstrap_interval(cases: DataFrame, keys: Sequence[str], cluster: str, value: str, seed: int, draws: int = 1000) -> DataFrame:
    """keys, mae, low, high: storms are drawn with replacement, and each draw's sum of sums is divided by its sum of counts.

    Storms are summed up first, so a group holds one row a storm. seed is added to the sum of the
    keys' numbers, which makes each group's draws its own and repeatable.
    """
    sums = cases.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(F.abs(value)).alias("_s"), F.count("*").alias("_n"))
    shape = ", ".join(f"`{k}` {dict(cases.dtypes)[k]}" for k in keys)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(cluster, kind="stable")
        s, n = group["_s"].to_numpy(float), group["_n"].to_numpy(float)
        own = group[list(keys)].iloc[:1].reset_index(drop=True)
        rng = np.random.default_rng(seed + int(sum(own.iloc[0])))
        pick = rng.integers(0, len(s), (draws, len(s)))
        low, high = np.quantile(s[pick].sum(axis=1) / n[pick].sum(axis=1), [0.025, 0.975])
        return own.assign(mae=s.sum() / n.sum(), low=low, high=high)

    return sums.groupBy(*keys).applyInPandas(run, f"{shape}, mae double, low double, high double")


def bootstrap_by_formula(cases: DataFrame, keys: Sequence[str], cluster: str, value: str, seed: int = 1, draws: int = 200) -> DataFrame:
    """The same interval with draws from a linear congruence instead of a generator: functions of SQL only."""
    sums = cases.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(F.abs(value)).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    storms = sums.withColumns({"at": F.row_number().over(w.orderBy(cluster)) - 1, "m": F.count("*").over(w)})
    # the windows leave a group's storms in one task: they are dealt out before their draws are made
    slots = storms.select(*keys, "m", F.col("at").alias("slot")).repartition(int(cases.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "slot").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    mixed = (F.col("draw").cast("long") * 7919 + F.col("slot").cast("long") * 104_729 + seed) * 48_271 % 2_147_483_647
    slots = slots.withColumn("at", (mixed * 48_271 % 2_147_483_647 % F.col("m")).cast("int"))
    drawn = slots.join(merged(storms.select(*keys, "at", "s", "n")), [*keys, "at"]).groupBy(*keys, "draw").agg((F.sum("s") / F.sum("n")).alias("mae"))
    return drawn.groupBy(*keys).agg(F.percentile("mae", F.lit(0.025)).alias("low"), F.percentile("mae", F.lit(0.975)).alias("high"))
