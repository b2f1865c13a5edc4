"""Grouping over the dense iterations 1 to n: groups without rows count."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dense(df: DataFrame, n: int, key: str = "iteration", **aggregates: tuple[Column, float]) -> DataFrame:
    """A row for each key 1 to n: aggregates by name, with the value of groups without rows. Rows are
    aggregated before they meet the keys."""
    by = df.where(F.col(key).between(1, n)).groupBy(key).agg(*[c.alias(k) for k, (c, _) in aggregates.items()])
    keys = df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias(key))
    return keys.join(by, key, "left").select(key, *[F.coalesce(k, F.lit(v)).alias(k) for k, (_, v) in aggregates.items()])


def group_sum(df: DataFrame, n: int, value: str = "amount", key: str = "iteration") -> DataFrame:
    return dense(df, n, key, total=(F.sum(value), 0.0))


def group_count(df: DataFrame, n: int, key: str = "iteration") -> DataFrame:
    return dense(df, n, key, events=(F.count(F.lit(1)), 0))


def group_max(df: DataFrame, n: int, value: str = "amount", key: str = "iteration") -> DataFrame:
    return dense(df, n, key, largest=(F.max(value), -math.inf))


def ordered(key: str = "iteration", *by: str):
    return Window.partitionBy(key).orderBy(*(by or ("day", "seq")))


def running(key: str = "iteration", *by: str):
    return ordered(key, *by).rowsBetween(Window.unboundedPreceding, 0)


def group_cumsum(df: DataFrame, value: str = "amount", key: str = "iteration", by: tuple[str, ...] = ("day", "seq")) -> DataFrame:
    return df.withColumn("cumulative", F.sum(value).over(running(key, *by)))


def group_diff(df: DataFrame, value: str = "amount", key: str = "iteration", by: tuple[str, ...] = ("day", "seq")) -> DataFrame:
    """The first of a group stays, then differences."""
    return df.withColumn("difference", F.col(value) - F.coalesce(F.lag(value).over(ordered(key, *by)), F.lit(0.0)))


def frequency_stats(df: DataFrame, n: int) -> DataFrame:
    """mean_freq, mean_loss, cluster_coeff (1/k of a negative binomial) and variance_mean_ratio."""
    both = dense(df, n, events=(F.count(F.lit(1)), 0), total=(F.sum("amount"), 0.0))
    m, v = F.avg("events"), F.var_samp("events")
    return both.agg(m.alias("mean_freq"), (F.sum("total") / n).alias("mean_loss"), ((v - m) / (m * m)).alias("cluster_coeff"), (v / m).alias("variance_mean_ratio"))


def _curve(per_iteration: DataFrame, value: str, n: int) -> DataFrame:
    # one row for each iteration, so the one window is over n rows
    rank = F.row_number().over(Window.orderBy(F.desc(value), "iteration"))
    return per_iteration.select("iteration", F.col(value).alias("amount"), (F.lit(float(n)) / rank).alias("return_period"))


def aep(df: DataFrame, n: int) -> DataFrame:
    """Aggregate exceedance: (iteration, amount, return_period), the largest at n."""
    return _curve(group_sum(df, n), "total", n)


def oep(df: DataFrame, n: int) -> DataFrame:
    """Occurrence exceedance; iterations without events are at minus infinity."""
    return _curve(group_max(df, n), "largest", n)
