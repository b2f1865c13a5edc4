"""Matrices as rows (mat_id, row, col, value) and N-dimensional arrays as rows (i0, i1, ..., value)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["mat_id"]


class ShapeMismatch(ValueError):
    """Shapes that don't go together."""


def from_arrays(df: DataFrame, array: str, row: str, mat_id: Column | int = 0) -> DataFrame:
    m = F.lit(mat_id) if isinstance(mat_id, int) else mat_id
    return df.select(m.alias("mat_id"), F.col(row).alias("row"), F.posexplode(array).alias("col", "v")).select("mat_id", "row", "col", F.col("v").cast("double").alias("value"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select("mat_id", F.col("col").alias("row"), F.col("row").alias("col"), "value")


def matmul(a: DataFrame, b: DataFrame, add: Callable[[Column], Column] = F.sum, times: Callable[[Column, Column], Column] = lambda x, y: x * y) -> DataFrame:
    """a times b by a join on the inner index and a grouped sum; add and times may be another ring's."""
    x = a.select("mat_id", "row", F.col("col").alias("__k"), F.col("value").alias("__x"))
    y = b.select("mat_id", F.col("row").alias("__k"), "col", F.col("value").alias("__y"))
    return x.join(y, ["mat_id", "__k"]).groupBy("mat_id", "row", "col").agg(add(times(F.col("__x"), F.col("__y"))).alias("value"))


def matvec(a: DataFrame, v: DataFrame) -> DataFrame:
    """a times v (idx, value): (mat_id, idx, value)."""
    return a.join(v.select(F.col("idx").alias("col"), F.col("value").alias("__v")), "col").groupBy("mat_id", F.col("row").alias("idx")).agg(F.sum(F.col("value") * F.col("__v")).alias("value"))


def combined(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """Element by element."""
    return a.join(b.withColumnRenamed("value", "__b"), ["mat_id", "row", "col"]).select("mat_id", "row", "col", f(F.col("value"), F.col("__b")).alias("value"))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    return combined(a, b, lambda x, y: x * y)


def kronecker(a: DataFrame, b: DataFrame, rows: int, cols: int) -> DataFrame:
    """b has rows and cols; every element of a meets every one of b, as the result has them all."""
    y = b.select("mat_id", F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("value").alias("__v"))
    return a.join(y, "mat_id").select("mat_id", (F.col("row") * rows + F.col("__r")).alias("row"), (F.col("col") * cols + F.col("__c")).alias("col"), (F.col("value") * F.col("__v")).alias("value"))


def mapped(m: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return m.withColumn("value", f(F.col("value")))


def reduced(m: DataFrame, axis: str, how: str = "sum") -> DataFrame:
    """axis rows gives a value per row, cols one per column; how: sum, mean, min, max, product, norm, argmax."""
    key, other = ("row", "col") if axis == "rows" else ("col", "row")
    v = F.col("value")
    f = {"sum": F.sum(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "product": F.product(v), "norm": F.sqrt(F.sum(v * v)), "argmax": F.min_by(F.col(other), F.struct(-v, F.col(other)))}[how]
    return m.groupBy("mat_id", key).agg(f.alias("value"))


def map_lines(m: DataFrame, axis: str, f: Callable[[Column], Column]) -> DataFrame:
    """f of each row (or column) as an array, in order."""
    key, other = ("row", "col") if axis == "rows" else ("col", "row")
    a = F.transform(F.array_sort(F.collect_list(F.struct(other, "value"))), lambda x: x["value"])
    return m.groupBy("mat_id", key).agg(a.alias("a")).select("mat_id", key, F.posexplode(f(F.col("a"))).alias(other, "value")).select("mat_id", "row", "col", "value")


def trace(m: DataFrame) -> DataFrame:
    return m.where("row = col").groupBy("mat_id").agg(F.sum("value").alias("value"))


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("row = col").select("mat_id", F.col("row").alias("idx"), "value")


def row_of(m: DataFrame, i: int) -> DataFrame:
    return m.where(F.col("row") == i).select("mat_id", F.col("col").alias("idx"), "value")


def col_of(m: DataFrame, j: int) -> DataFrame:
    return m.where(F.col("col") == j).select("mat_id", F.col("row").alias("idx"), "value")


def submatrix(m: DataFrame, rows: list[int] | None = None, cols: list[int] | None = None) -> DataFrame:
    """Rows and columns in the order given, which may repeat; None takes all as they are."""
    for name, chosen in (("row", rows), ("col", cols)):
        if chosen is not None:
            t = m.sparkSession.createDataFrame(list(enumerate(chosen)), f"__to int, {name} int")
            m = m.join(F.broadcast(t), name).drop(name).withColumnRenamed("__to", name)
    return m.select("mat_id", "row", "col", "value")


def horzcat(a: DataFrame, b: DataFrame, cols_a: int) -> DataFrame:
    return a.unionByName(b.withColumn("col", F.col("col") + cols_a))


def vertcat(a: DataFrame, b: DataFrame, rows_a: int) -> DataFrame:
    return a.unionByName(b.withColumn("row", F.col("row") + rows_a))


def filled(spark, rows: int, cols: int, value: float | Column = 0.0, mat_id: int = 0) -> DataFrame:
    v = F.lit(value) if not isinstance(value, Column) else value
    return spark.range(rows * cols).select(F.lit(mat_id).alias("mat_id"), (F.col("id") % rows).cast("int").alias("row"), F.floor(F.col("id") / rows).cast("int").alias("col")).withColumn("value", v.cast("double"))


def eye(spark, n: int) -> DataFrame:
    return filled(spark, n, n, (F.col("row") == F.col("col")).cast("double"))


def random(spark, rows: int, cols: int, seed: int) -> DataFrame:
    return filled(spark, rows, cols, F.rand(seed))


def random_ints(spark, rows: int, cols: int, low: int, high: int, seed: int) -> DataFrame:
    """Whole numbers from low to below high."""
    return filled(spark, rows, cols, F.floor(F.rand(seed) * (high - low)) + low)


def tiled(m: DataFrame, rows: int, cols: int, down: int, across: int) -> DataFrame:
    t = m.withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    return t.select("mat_id", (F.col("row") + F.col("__d") * rows).alias("row"), (F.col("col") + F.col("__a") * cols).alias("col"), "value")


def updated(m: DataFrame, mask: Column, value: float) -> DataFrame:
    return m.withColumn("value", F.when(mask, F.lit(float(value))).otherwise(F.col("value")))


# ---- N-dimensional arrays: axes i0, i1, ...


class NDArray:
    """Rows (i0, ..., value) and a shape; a row for each element."""

    def __init__(self, rows: DataFrame, shape: tuple[int, ...]):
        self.rows, self.shape = rows, tuple(shape)

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.shape))]

    def _remade(self, columns: list[Column], shape: tuple[int, ...]) -> NDArray:
        return NDArray(self.rows.select(*[c.cast("int").alias(f"i{k}") for k, c in enumerate(columns)], "value"), shape)

    def slice(self, axis: int, start: int, stop: int, step: int = 1) -> NDArray:
        a = F.col(f"i{axis}")
        shape = list(self.shape)
        shape[axis] = len(range(start, stop, step))
        kept = NDArray(self.rows.where((a >= start) & (a < stop) & ((a - start) % step == 0)), self.shape)
        return kept._remade([F.floor((F.col(x) - start) / step) if k == axis else F.col(x) for k, x in enumerate(self.axes)], tuple(shape))

    def permute(self, order: list[int]) -> NDArray:
        return self._remade([F.col(f"i{k}") for k in order], tuple(self.shape[k] for k in order))

    def reshape(self, shape: tuple[int, ...]) -> NDArray:
        """In column-major order: the first axis runs fastest."""
        if reduce(lambda a, b: a * b, shape, 1) != reduce(lambda a, b: a * b, self.shape, 1):
            raise ShapeMismatch(f"{self.shape} has not as many elements as {shape}")
        at, step = F.lit(0).cast("long"), 1
        for x, n in zip(self.axes, self.shape, strict=True):
            at, step = at + F.col(x) * step, step * n
        columns, step = [], 1
        for n in shape:
            columns.append(F.floor(at / step) % n)
            step *= n
        return self._remade(columns, tuple(shape))

    def squeeze(self) -> NDArray:
        keep = [k for k, n in enumerate(self.shape) if n != 1]
        return self._remade([F.col(f"i{k}") for k in keep], tuple(self.shape[k] for k in keep))

    def unsqueeze(self, axis: int) -> NDArray:
        columns = [F.col(x) for x in self.axes]
        return self._remade([*columns[:axis], F.lit(0), *columns[axis:]], (*self.shape[:axis], 1, *self.shape[axis:]))

    def flatten(self) -> NDArray:
        return self.reshape((reduce(lambda a, b: a * b, self.shape, 1),))

    def reduce(self, axis: int | None, f: Callable[[Column], Column] = F.sum) -> NDArray:
        """Removes the axis, or all where it is None."""
        keep = [] if axis is None else [k for k in range(len(self.shape)) if k != axis]
        by = [f"i{k}" for k in keep]
        out = self.rows.groupBy(*by).agg(f(F.col("value")).alias("value"))
        return NDArray(out, self.shape)._remade([F.col(x) for x in by], tuple(self.shape[k] for k in keep))

    def argmax(self, axis: int) -> NDArray:
        by = [x for k, x in enumerate(self.axes) if k != axis]
        out = self.rows.groupBy(*by).agg(F.min_by(F.col(f"i{axis}"), F.struct(-F.col("value"), F.col(f"i{axis}"))).alias("value"))
        return NDArray(out, self.shape)._remade([F.col(x) for x in by], tuple(n for k, n in enumerate(self.shape) if k != axis))

    def map(self, f: Callable[[Column], Column]) -> NDArray:
        return NDArray(self.rows.withColumn("value", f(F.col("value"))), self.shape)

    def broadcast_to(self, shape: tuple[int, ...]) -> NDArray:
        """Aligned at the last axis; axes of one element repeat."""
        lead = len(shape) - len(self.shape)
        if lead < 0 or any(n not in (1, shape[lead + k]) for k, n in enumerate(self.shape)):
            raise ShapeMismatch(f"{self.shape} can't become {shape}")
        rows, columns = self.rows, []
        for k, n in enumerate(shape):
            if k < lead or self.shape[k - lead] != n:
                rows = rows.withColumn(f"__b{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
                columns.append(F.col(f"__b{k}"))
            else:
                columns.append(F.col(f"i{k - lead}"))
        return NDArray(rows, self.shape)._remade(columns, tuple(shape))

    def combine(self, other: NDArray, f: Callable[[Column, Column], Column]) -> NDArray:
        """Shapes must be equal, but for a single value on either side."""
        if not self.shape and other.shape:
            return other.combine(self, lambda x, y: f(y, x))
        if not other.shape:
            x = F.broadcast(other.rows.select(F.col("value").alias("__b")))
            return NDArray(self.rows.join(x).select(*self.axes, f(F.col("value"), F.col("__b")).alias("value")), self.shape)
        if other.shape != self.shape:
            raise ShapeMismatch(f"{self.shape} and {other.shape}")
        return NDArray(self.rows.join(other.rows.withColumnRenamed("value", "__b"), self.axes).select(*self.axes, f(F.col("value"), F.col("__b")).alias("value")), self.shape)

    def cumsum(self, axis: int) -> NDArray:
        w = Window.partitionBy(*[x for k, x in enumerate(self.axes) if k != axis]).orderBy(f"i{axis}").rowsBetween(Window.unboundedPreceding, 0)
        return NDArray(self.rows.withColumn("value", F.sum("value").over(w)), self.shape)


def broadcast_shape(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    n = max(len(a), len(b))
    x, y = (1,) * (n - len(a)) + tuple(a), (1,) * (n - len(b)) + tuple(b)
    if any(p != q and 1 not in (p, q) for p, q in zip(x, y, strict=True)):
        raise ShapeMismatch(f"{a} and {b}")
    return tuple(max(p, q) for p, q in zip(x, y, strict=True))
