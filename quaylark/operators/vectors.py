"""Vectors as array columns (element by element, no shuffle) and as rows (vec_id, idx, value)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaylark.functions import numeric

# ---- arrays


def each(a: Column, f: Callable[[Column], Column] | str) -> Column:
    """f, or the function of that name in numeric.UNARY, of each element."""
    return F.transform(a, numeric.UNARY[f] if isinstance(f, str) else f)


def zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of elements in pairs; arrays of unlike length raise."""
    pairs = F.zip_with(a, b, f)
    return F.when(F.size(a) == F.size(b), pairs).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))


def add(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x.cast("double") + y)


def subtract(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x.cast("double") - y)


def multiply(a: Column, b: Column) -> Column:
    return zipped(a, b, lambda x, y: x.cast("double") * y)


def divide(a: Column, b: Column) -> Column:
    return zipped(a, b, numeric.divide)


def fma(a: Column, by: float, plus: float) -> Column:
    return F.transform(a, lambda x: x * by + plus)


def power(a: Column, p: float) -> Column:
    return F.transform(a, lambda x: F.pow(x, F.lit(p)))


def clamp(a: Column, low: float | None = None, high: float | None = None) -> Column:
    return F.transform(a, lambda x: numeric.clamp(x, low, high))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def variance(a: Column, sample: bool = False) -> Column:
    """Two passes: the mean, then the squares around it."""
    return F.aggregate(a, F.struct(F.lit(0.0).alias("s"), mean(a).alias("m")), lambda s, x: F.struct((s["s"] + F.pow(x - s["m"], 2)).alias("s"), s["m"].alias("m")), lambda s: s["s"]) / (F.size(a) - int(sample))


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def argmax(a: Column) -> Column:
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def compared(a: Column, op: str, b: Column | float) -> Column:
    """A mask; NaN compares false but with !=."""
    ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}

    def f(x: Column, y: Column) -> Column:
        odd = F.isnan(x.cast("double")) | F.isnan(y.cast("double"))
        return F.when(odd, op == "!=").otherwise(ops[op](x, y))

    return F.zip_with(a, b, f) if isinstance(b, Column) else F.transform(a, lambda x: f(x, F.lit(b)))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x & y)


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x | y)


def negated(a: Column) -> Column:
    return F.transform(a, lambda x: ~x)


def count_true(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x))


def all_true(a: Column) -> Column:
    return F.forall(a, lambda x: x)


def any_true(a: Column) -> Column:
    return F.exists(a, lambda x: x)


def masked(a: Column, mask: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(a.alias("v"), mask.alias("m")), lambda x: x["m"]), lambda x: x["v"])


def where(mask: Column, a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(mask.alias("m"), a.alias("a"), b.alias("b")), lambda x: F.when(x["m"], x["a"]).otherwise(x["b"]))


def zero_where(a: Column, mask: Column) -> Column:
    return F.zip_with(a, mask, lambda x, m: F.when(m, F.lit(0.0)).otherwise(x))


def take(a: Column, indices: list[int]) -> Column:
    return F.array(*[F.get(a, i) for i in indices])


def cumsum(a: Column) -> Column:
    step = lambda s, x: F.concat(s, F.array(F.coalesce(F.element_at(s, -1), F.lit(0.0)) + x))
    return F.aggregate(a, F.array().cast("array<double>"), lambda s, x: F.when(F.size(s) == 0, F.array(x.cast("double"))).otherwise(step(s, x)))


def increments(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(a, i - 1)))


def unique(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def argsort(a: Column) -> Column:
    """Indices in order of value, ties by index, NaN last."""
    pairs = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def linspace(a: float, b: float, n: int = 100) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == n - 1, F.lit(float(b))).otherwise(a + (b - a) / max(n - 1, 1) * i))


def counts_to_indices(a: Column) -> Column:
    return F.flatten(F.transform(a, lambda n, i: F.array_repeat(i, n)))


def outer(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.transform(b, lambda y: x * y))


# ---- rows


def as_rows(df: DataFrame, key: str, array: str) -> DataFrame:
    return df.select(F.col(key).alias("vec_id"), F.posexplode(array).alias("idx", "v")).select("vec_id", "idx", F.col("v").cast("double").alias("value"))


def as_arrays(rows: DataFrame) -> DataFrame:
    a = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"])
    return rows.groupBy("vec_id").agg(a.alias("v"))


def reductions(rows: DataFrame) -> DataFrame:
    v = F.col("value")
    return rows.groupBy("vec_id").agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.product(v).alias("product"), F.avg(v).alias("mean"), F.min(v).alias("smallest"), F.max(v).alias("largest"), F.var_pop(v).alias("variance"), F.var_samp(v).alias("sample_variance"), F.stddev_pop(v).alias("std"), F.sqrt(F.sum(v * v)).alias("norm"), F.min_by("idx", F.struct(-v, "idx")).alias("argmax"), F.min_by("idx", F.struct(v, "idx")).alias("argmin"))


def scanned(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("vec_id").orderBy("idx")
    return rows.withColumn("cumsum", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("increment", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)))


def product_except_self(rows: DataFrame) -> DataFrame:
    """Counts of zeros tell where a product without the element is zero."""
    w = Window.partitionBy("vec_id")
    zero = F.col("value") == 0
    rest = F.product(F.when(zero, 1.0).otherwise(F.col("value"))).over(w)
    zeros = F.count(F.when(zero, 1)).over(w)
    return rows.withColumn("others", F.when(zeros == 0, rest / F.when(zero, 1.0).otherwise(F.col("value"))).when((zeros == 1) & zero, rest).otherwise(0.0))


def element_ranks(rows: DataFrame, value: str = "value", by: str = "vec_id") -> DataFrame:
    """Ranks from 1, ties at their average."""
    w = Window.partitionBy(by)
    return rows.withColumn("rank", F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(by, value)) - 1) / 2)


def pair_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """Sample covariance and Pearson's correlation of two columns."""
    return df.agg(F.covar_samp(x, y).alias("covariance"), F.corr(x, y).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Spearman's correlation of two columns within each group of by."""
    r = element_ranks(df, x, by).withColumnRenamed("rank", "__rx")
    r = element_ranks(r, y, by)
    return r.groupBy(by).agg(F.corr("__rx", "rank").alias("spearman"))


NAN = math.nan
