"""Delimited text of arrays and matrices, and tables with a header: strict readers and overwriting writers.

Rows are numbered by file, block of a file and place in it; what is gathered for that is a row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _lines(spark: SparkSession, path: str, drop: int, sep: str) -> DataFrame:
    """(row, first, cells): rows from 0 in the order of file names and places, the cells before each, and its
    own. Blank lines don't count."""
    if drop < 0:
        raise ValueError("drop must not be negative")
    text = spark.read.text(path).where(F.trim("value") != "")
    cells = F.split("value", f"\\Q{sep}\\E")
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    # ids rise by one along a block
    lines = text.select(*block, F.monotonically_increasing_id().alias("at"), cells.alias("cells"))
    blocks = lines.groupBy("file", "start").agg(F.min("at").alias("from"), F.count(F.lit(1)).alias("lines"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("rows", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    numbered = lines.join(blocks, ["file", "start"]).withColumn("row", F.col("rows") + F.col("at") - F.col("from")).where(F.col("row") >= drop)
    w = Window.partitionBy("file", "start").orderBy("row")
    # the dropped rows' cells don't count
    sizes = numbered.groupBy("file", "start").agg(F.sum(F.size("cells")).alias("size")).withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    own = F.sum(F.size("cells")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.size("cells")
    return numbered.join(sizes, ["file", "start"]).select((F.col("row") - drop).cast("int").alias("row"), (F.col("first") + own).alias("first"), "cells")


def _cell(value: Column, kind: str) -> Column:
    v = F.trim(value)
    return F.when(v == "", F.raise_error(F.lit("empty cell")).cast(kind)).otherwise(v.cast(kind))


def load_array(spark: SparkSession, path: str, sep: str = ",", drop_rows: int = 0, kind: str = "double") -> DataFrame:
    """(idx, value) of all cells, row by row. An empty or malformed cell raises when it is read."""
    cells = _lines(spark, path, drop_rows, sep).select("first", F.posexplode("cells").alias("col", "cell"))
    return cells.select((F.col("first") + F.col("col")).alias("idx"), _cell(F.col("cell"), kind).alias("value"))


def load_matrix(spark: SparkSession, path: str, sep: str = ",", drop_rows: int = 0, kind: str = "double") -> DataFrame:
    """(row, col, value); rows of differing lengths raise ValueError."""
    rows = _lines(spark, path, drop_rows, sep).select("row", "cells")
    if rows.select(F.size("cells")).distinct().limit(2).count() > 1:
        raise ValueError("rows have differing lengths")
    return rows.select("row", F.posexplode("cells").alias("col", "cell")).select("row", "col", _cell(F.col("cell"), kind).alias("value"))


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of text with a header; white space around cells doesn't count, a malformed cell raises."""
    return spark.read.schema(schema).csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST")


def write_array(df: DataFrame, path: str, sep: str = ",") -> None:
    """One line of value in order of idx; it is one row, so the array must fit a task."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"].cast("string")), sep)
    df.agg(line.alias("value")).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, path: str, sep: str = ",") -> None:
    """A line for each row, in order along the files; an empty matrix gives no line."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"].cast("string")), sep)
    df.groupBy("row").agg(line.alias("value")).orderBy("row").select("value").write.mode("overwrite").text(path)
