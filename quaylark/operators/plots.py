"""Rows for plots: counts against distributions, trends, survival, indices."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaylark.functions.distributions import Trend
from quaylark.operators.indices import YearIndex


def _against(df: DataFrame, value: str, dist, sds: float, reach: bool) -> DataFrame:
    """(k, observed, p) for k from 0 to mean + sds standard deviations, or the largest count if reach."""
    top = math.ceil(dist.mean + sds * math.sqrt(dist.variance))
    if reach:
        top = max(top, df.agg(F.max(value)).first()[0] or 0)
    rows = [(k, dist.probability_of(k)) for k in range(int(top) + 1)]
    table = df.sparkSession.createDataFrame(rows, "k int, p double")
    counts = df.groupBy(F.col(value).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("observed"))
    return table.join(counts, "k", "left").select("k", F.coalesce("observed", F.lit(0)).alias("observed"), "p")


def ecdf_vs_cdf(df: DataFrame, value: str, dist) -> DataFrame:
    n = df.count()
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return _against(df, value, dist, 4, True).select("k", (F.sum("observed").over(w) / n).alias("ecdf"), F.sum("p").over(w).alias("cdf"))


def rootogram(df: DataFrame, value: str, dist) -> DataFrame:
    n = df.count()
    e, o = F.sqrt(F.col("p") * n), F.sqrt("observed")
    return _against(df, value, dist, 3, False).select("k", e.alias("expected"), o.alias("observed"), (e - o).alias("hanging"))


def pearson_residuals(df: DataFrame, value: str, dist) -> DataFrame:
    e = F.col("p") * df.count()
    return _against(df, value, dist, 3, False).where(e > 0.001).select("k", ((F.col("observed") - e) / F.sqrt(e)).alias("residual"))


def trend_rows(spark: SparkSession, trend: Trend, first: int, last: int) -> DataFrame:
    """(year, fit, low, high) with 95 % bounds by the coefficients' variances and covariance."""
    centre, intercept, both, slope = trend.centred
    t = F.col("id") - centre
    eta = trend.intercept + trend.slope * F.col("id")
    se = F.sqrt(intercept + 2 * both * t + slope * t * t)
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"), F.exp(eta).alias("fit"), F.exp(eta - 1.96 * se).alias("low"), F.exp(eta + 1.96 * se).alias("high"))


def log_log_survival(df: DataFrame, value: str, tie: str) -> DataFrame:
    """(x, survival) of the sample: (n - i - 0.5) / n for the ith value from 0."""
    from quaylark.operators.tail import ranked

    n = df.count()
    return ranked(df.select(value, tie), value, tie).select(F.col(value).alias("x"), ((F.lit(n) - F.col("rank") + 0.5) / n).alias("survival"))


def model_survival(spark: SparkSession, dist, low: float, high: float, points: int = 200) -> DataFrame:
    step = (math.log(high) - math.log(low)) / (points - 1)
    xs = [math.exp(math.log(low) + i * step) for i in range(points)]
    return spark.createDataFrame([(x, 1 - dist.cdf(x)) for x in xs], "x double, survival double")


def index_rows(spark: SparkSession, index: YearIndex, threshold: float) -> DataFrame:
    rows = [(y, i, 1 / index.factor(y), threshold / index.factor(y)) for y, i in zip(index.years, index.indices, strict=True)]
    return spark.createDataFrame(rows, "year int, idx double, relative double, threshold double")
