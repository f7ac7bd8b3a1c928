"""Aliased loops: paths of one cluster that belong to different loops, told apart by time.

The occurrences of one rank in a cluster make a sparse matrix, a row a path, in the order of first
instants. A column is one round through the rows: it starts anew when time goes back to the same or
an earlier row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wrap_columns(rows: DataFrame, keys: list[str], path: str, t: str) -> DataFrame:
    """(keys, path, t, row, col, nth): the row from 1, the column from 0, and which occurrence of its path it is, from 0."""
    first = rows.withColumn("_first", F.min(t).over(Window.partitionBy(*keys, path)))
    placed = first.withColumn("row", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first", path)))
    along = Window.partitionBy(*keys).orderBy(t, "row")
    wraps = placed.withColumn("_wrap", F.coalesce((F.col("row") <= F.lag("row").over(along)).cast("int"), F.lit(0)))
    cols = wraps.withColumn("col", F.sum("_wrap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return cols.select(*keys, path, t, "row", "col", (F.row_number().over(Window.partitionBy(*keys, path).orderBy(t)) - 1).cast("long").alias("nth"))


def aliased(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Per matrix whether any voids are needed to bring its columns into time order."""
    return matrix.groupBy(*keys).agg((F.max((F.col("col") != F.col("nth")).cast("int")) == 1).alias("aliased"))


def dense_runs(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, c0, c1): runs of filled columns of each row."""
    along = Window.partitionBy(*keys, "row").orderBy("col")
    runs = matrix.withColumn("_run", F.col("col") - F.row_number().over(along))
    return runs.groupBy(*keys, "row", "_run").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("t").alias("t0")).drop("_run")


def dense_blocks(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r0, r1, c0, c1, t0): neighbouring rows with runs over the same columns, and when they start."""
    along = Window.partitionBy(*keys, "c0", "c1").orderBy("row")
    found = runs.withColumn("_island", F.col("row") - F.row_number().over(along))
    return found.groupBy(*keys, "c0", "c1", "_island").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("t0").alias("t0")).drop("_island")


def subloops(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, r0, r1, n_blocks, iterations, spans): blocks over the same rows are one loop, run so often."""
    return blocks.groupBy(*keys, "r0", "r1").agg(F.count("*").alias("n_blocks"), F.sum(F.col("c1") - F.col("c0") + 1).alias("iterations"), F.sort_array(F.collect_list(F.struct("c0", "c1"))).alias("spans"))


def period(sequence: str, out: str = "period"):
    """The smallest length whose repetition makes the array column, a divisor of its length."""
    fits = f"filter(sequence(1, size({sequence})), p -> size({sequence}) % p = 0 and forall(sequence(0, size({sequence}) - 1), i -> {sequence}[i] = {sequence}[cast(i % p as int)]))"
    return F.expr(f"case when size({sequence}) > 0 then {fits}[0] end").alias(out)


def superloops(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Per matrix the hidden loop around its sub-loops: the period of the blocks' row sets in time, and how often it runs."""
    seq = blocks.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("t0", "r0", "r1"))), lambda b: F.concat_ws("-", b["r0"], b["r1"])).alias("seq"))
    found = seq.withColumn("period", period("seq")).withColumn("iterations", (F.size("seq") / F.col("period")).cast("long"))
    return found.withColumn("hidden", (F.col("iterations") > 1) & (F.size(F.array_distinct("seq")) > 1)).select(*keys, "period", "iterations", "hidden")
