"""Ordered folds over short sequences as higher-order functions, and windows over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .profile import apart


def sorted_curve(df: DataFrame, keys: list[str], order: str, value: str, name: str = "curve") -> DataFrame:
    """(keys, curve): the values of each key in order. Curves are epochs of a run, hence short."""
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias(name))


def entropy_stop(curve: Column, patience: Column | int, drop: Column | float) -> Column:
    """Epoch (0-based) of the last accepted minimum of a curve.

    A value below the minimum is accepted if its drop, as a share of the variation gone through
    since the last accepted one, is above `drop`; anything else counts against the patience,
    and the fold stops when that is used up.
    """
    k, r = (c if isinstance(c, Column) else F.lit(c) for c in (patience, drop))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("best"), curve[0].alias("low"), curve[0].alias("last"), F.lit(0.0).cast("double").alias("moved"), F.lit(0).alias("bad"))

    def step(s: Column, v: Column) -> Column:
        i, moved = s["i"] + 1, s["moved"] + F.abs(v - s["last"])
        ok = (v < s["low"]) & ((s["low"] - v) > r * moved)
        on = s["bad"] < k
        new = F.struct(i.alias("i"), F.when(ok, i).otherwise(s["best"]).alias("best"), F.when(ok, v).otherwise(s["low"]).alias("low"), v.alias("last"), F.when(ok, 0.0).otherwise(moved).alias("moved"), F.when(ok, 0).otherwise(s["bad"] + 1).alias("bad"))
        return F.when(on, new).otherwise(s)

    rest = F.slice(curve, 2, F.greatest(F.size(curve) - 1, F.lit(0)))
    return F.when(F.size(curve) > 0, F.aggregate(rest, start, step, lambda s: s["best"]))


def patience_stop(curve: Column, patience: int) -> Column:
    """(best, censored): epoch of the minimum before `patience` epochs without a better one; censored if the curve ends first."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("best"), curve[0].alias("low"))

    def step(s: Column, v: Column) -> Column:
        i = s["i"] + 1
        on, better = s["i"] - s["best"] < patience, v < s["low"]
        return F.when(on, F.struct(i.alias("i"), F.when(better, i).otherwise(s["best"]).alias("best"), F.when(better, v).otherwise(s["low"]).alias("low"))).otherwise(s)

    rest = F.slice(curve, 2, F.greatest(F.size(curve) - 1, F.lit(0)))
    return F.when(F.size(curve) > 0, F.aggregate(rest, start, step, lambda s: F.struct(s["best"].alias("best"), (s["i"] - s["best"] < patience).alias("censored"))))


def ema(values: Column, alpha: float = 0.3) -> Column:
    """The moving average after the last value; it starts at the first."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, values[0].cast("double"), lambda s, v: (1 - alpha) * s + alpha * v))


def alert_rate(df: DataFrame, time: str, flows: str, alerts: str, seconds: int = 300, keys: list[str] | None = None, bucket: int = 86_400) -> DataFrame:
    """df with window_flows, window_alerts and window_rate over the last `seconds`, both ends included.

    Time is cut into buckets of a day; rows of the last `seconds` of a bucket are copied into the
    next one as context, so that no window spans all of time in one task.
    """
    keys = keys or []
    mine, at = apart([*df.columns, "window_flows", "window_alerts", "window_rate"], "own", "bucket")
    own = F.floor(F.col(time) / bucket)
    reach = F.floor((F.col(time) + seconds) / bucket)
    spread = df.withColumn(mine, own).withColumn(at, F.explode(F.array_distinct(F.array(own, reach))))
    w = W.partitionBy(*keys, at).orderBy(time).rangeBetween(-seconds, 0)
    got = spread.withColumns({"window_flows": F.sum(flows).over(w), "window_alerts": F.sum(alerts).over(w)}).where(F.col(at) == F.col(mine))
    rate = F.when(F.col("window_flows") > 0, F.col("window_alerts") / F.col("window_flows")).otherwise(0.0)
    return got.withColumn("window_rate", rate).drop(mine, at)
