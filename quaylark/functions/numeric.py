"""Unary maths with IEEE results, where Spark has nulls or errors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = F.lit, F.lit


def _nan() -> Column:
    return F.lit(math.nan)


def divide(x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    by_zero = F.when(x > 0, math.inf).when(x < 0, -math.inf).otherwise(math.nan)
    return F.when(F.isnan(x) | F.isnan(y), math.nan).when(y != 0, x / F.when(y != 0, y)).otherwise(by_zero)


def _log(f, edge: float):
    def g(x: Column) -> Column:
        return F.when(F.isnan(x) | (x < edge), math.nan).when(x == edge, -math.inf).otherwise(f(x))

    return g


log, log10, log1p = _log(F.log, 0.0), _log(F.log10, 0.0), _log(F.log1p, -1.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def least(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), math.nan).otherwise(F.least(x, y))


def greatest(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), math.nan).otherwise(F.greatest(x, y))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = greatest(x, F.lit(float(low)))
    return x if high is None else least(x, F.lit(float(high)))


UNARY = {"abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cbrt": F.cbrt, "cos": F.cos, "cosh": F.cosh, "exp": F.exp, "expm1": F.expm1, "log": log, "log10": log10, "log1p": log1p, "sqrt": F.sqrt, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh, "neg": lambda x: -x, "sigmoid": sigmoid}
