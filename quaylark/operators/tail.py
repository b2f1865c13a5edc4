"""Tail measures and tail-index estimators.

Ranks over all rows come in two steps: rows are cut at quantiles of the value and ranked within each
range, and the ranges' counts, as many as there are cuts, give the offset. No task sees all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTS = 64


def ranked(df: DataFrame, value: str, tie: str, descending: bool = False) -> DataFrame:
    """df with rank, 1 to n by value and then tie (ascending either way)."""
    cuts = sorted(set(df.approxQuantile(value, [i / CUTS for i in range(1, CUTS)], 0.005)))
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col(value) >= c).cast("int")
    if descending:
        part = -part
    cut = df.withColumn("__part", part)
    counts = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # at most CUTS rows
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(F.desc(value) if descending else F.asc(value), F.asc(tie)))
    return cut.withColumn("rank", own).join(F.broadcast(before), "__part").withColumn("rank", (F.col("rank") + F.col("__before")).cast("long")).drop("__part", "__before")


def tail_count(n: int, alpha: float) -> int:
    return math.floor(n * (1 - alpha) + 1e-11)


def var_tvar(df: DataFrame, alphas: list[float], value: str, tie: str) -> DataFrame:
    """(cl, var, tvar) for each alpha; losses are low values. No value in the tail gives NaN."""
    n = df.count()
    r = ranked(df, value, tie)
    rows = []
    for a in alphas:
        k = tail_count(n, a)
        rows.append(F.struct(F.lit(1 - a).alias("cl"), F.max(F.when(F.col("rank") == max(k, 1), F.col(value))).alias("var"), F.coalesce(F.avg(F.when(F.col("rank") <= k, F.col(value))), F.lit(math.nan)).alias("tvar")))
    return r.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def tail_mask(df: DataFrame, alpha: float, value: str, tie: str) -> DataFrame:
    return ranked(df, value, tie).withColumn("in_tail", F.col("rank") <= tail_count(df.count(), alpha)).drop("rank")


def quantile_dependence(df: DataFrame, alpha: float, x: str, y: str, tie: str) -> DataFrame:
    """(qdep): the share of rows in the upper tails of both."""
    n = df.count()
    k = math.floor(n * (1 - alpha))
    both = ranked(df.select(tie, x), x, tie, True).where(F.col("rank") <= k).select(tie).join(ranked(df.select(tie, y), y, tie, True).where(F.col("rank") <= k).select(tie), tie)
    return both.agg((F.count(F.lit(1)) / (n * (1 - alpha))).alias("qdep"))


def _top(df: DataFrame, value: str, tie: str, m: int) -> DataFrame:
    """The m largest, ranked; a top-m report, not a sort of all."""
    return df.orderBy(F.desc(value), tie).limit(m).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), tie)))


def hill_plot(df: DataFrame, value: str, tie: str, k_min: int = 2, k_max: int = -1, step: int = 1) -> DataFrame:
    """(k, estimate): k / sum of log(x_i / x_(k+1)) over the k largest."""
    n = df.count()
    k_max = min(n // 2, n - 1) if k_max < 0 else k_max
    if not 1 <= k_min <= k_max < n:
        raise ValueError("k must be at least 1 and below the count")
    w = Window.orderBy("rank")
    t = _top(df, value, tie, k_max + 1).withColumn("logs", F.sum(F.log(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead(value).over(w))
    fits = F.col("rank").between(k_min, k_max) & ((F.col("rank") - k_min) % step == 0)
    return t.where(fits).select(F.col("rank").alias("k"), (F.col("rank") / (F.col("logs") - F.col("rank") * F.log("next"))).alias("estimate"))


def hill(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    return hill_plot(df, value, tie, k, k)


def pickands_plot(df: DataFrame, value: str, tie: str, k_min: int = 1, k_max: int = -1, step: int = 1) -> DataFrame:
    """(k, gamma, alpha): from the kth, 2kth and 4kth largest; NaN where a difference isn't positive."""
    n = df.count()
    k_max = (n - 1) // 4 if k_max < 0 else k_max
    if n < 5 or not 1 <= k_min <= k_max or 4 * k_max >= n:
        raise ValueError("4 k must be below the count, of at least 5")
    t = _top(df, value, tie, 4 * k_max).select("rank", F.col(value).alias("x"))
    ks = df.sparkSession.range(k_min, k_max + 1, step).select(F.col("id").cast("int").alias("k"))
    at = lambda m: F.broadcast(t.select((F.col("rank") / m).alias("k"), F.col("x").alias(f"x{m}")).where(F.col("rank") % m == 0))
    j = ks.join(at(1), "k").join(at(2), "k").join(at(4), "k")
    a, b = F.col("x1") - F.col("x2"), F.col("x2") - F.col("x4")
    gamma = F.when((a > 0) & (b > 0), F.log2(F.when(a > 0, a) / F.when(b > 0, b))).otherwise(math.nan)
    return j.select("k", gamma.alias("gamma")).withColumn("alpha", F.when(~F.isnan("gamma") & (F.col("gamma") > 0), 1 / F.when(F.col("gamma") != 0, F.col("gamma"))).otherwise(math.nan))


def stable_region(plot: DataFrame, value: str = "estimate", window: int = 10, threshold: float = 0.1, above_zero: bool = False) -> DataFrame:
    """(k_start, k_end, mean) of the first window of consecutive rows, all finite, with the least coefficient of
    variation, if that is below threshold; above_zero asks for a positive mean."""
    w = Window.orderBy("k").rowsBetween(0, window - 1)
    x = F.col(value)
    finite = F.count(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), 1)).over(w)
    s = plot.select("k", finite.alias("finite"), F.max("k").over(w).alias("k_end"), F.avg(x).over(w).alias("mean"), F.stddev_pop(x).over(w).alias("sd"))
    s = s.where((F.col("finite") == window) & (F.col("mean") != 0)).withColumn("cv", F.col("sd") / F.abs("mean")).where(F.col("cv") < threshold)
    best = s.agg(F.min(F.struct("cv", "k", "k_end", "mean")).alias("x")).where("x is not null").select(F.col("x.k").alias("k_start"), "x.k_end", "x.mean")
    return best.where("mean > 0") if above_zero else best


def pickands_stable_region(plot: DataFrame, window: int = 5, threshold: float = 0.2) -> DataFrame:
    """(k_start, k_end, gamma, alpha) of the stable region of gamma, alpha its inverse."""
    return stable_region(plot, "gamma", window, threshold, True).select("k_start", "k_end", F.col("mean").alias("gamma"), (1 / F.col("mean")).alias("alpha"))
