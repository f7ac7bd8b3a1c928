"""Statistics of loops that a trace marks: intervals, iterations, counters and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def intervals(marks: DataFrame, keys: list[str], t: str, order: list[str], value: str) -> DataFrame:
    """(keys, depth, id, t_in, t_out, duration): from marks whose value is an id at entry and 0 at exit.

    The depth is the number open; an entry and the exit that takes the depth back have the same
    number at their depth.
    """
    along = Window.partitionBy(*keys).orderBy(t, *order)
    step = F.when(F.col(value) != 0, 1).otherwise(-1)
    depth = marks.withColumn("_s", step).withColumn("_after", F.sum("_s").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    level = depth.withColumn("depth", F.when(F.col("_s") == 1, F.col("_after")).otherwise(F.col("_after") + 1))
    at = Window.partitionBy(*keys, "depth").orderBy(t, *order)
    ahead = level.withColumn("t_out", F.lead(t).over(at)).withColumn("_n", F.lead(value).over(at))
    return ahead.where((F.col(value) != 0) & (F.col("_n") == 0)).select(*keys, "depth", F.col(value).alias("id"), F.col(t).alias("t_in"), "t_out", (F.col("t_out") - F.col(t)).alias("duration"))


def owner(inner: DataFrame, outer: DataFrame, keys: list[str], inner_t: str, out: str = "owner") -> DataFrame:
    """``inner`` with the id of the outer interval (id, t_in, t_out) that last began at or before and has not ended; outer intervals of a key don't overlap."""
    marks = outer.select(*keys, F.col("t_in").alias("_t"), F.lit(0).alias("_o"), F.struct("id", "t_out").alias("_w"))
    rows = inner.withColumn("_t", F.col(inner_t)).withColumn("_o", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    last = F.last("_w", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_w", last).where("_o = 1").withColumn(out, F.when(F.col("_w.t_out") > F.col("_t"), F.col("_w.id"))).drop("_t", "_o", "_w")


def statistics(rows: DataFrame, keys: list[str], duration: str, counters: tuple[str, ...] = ()) -> DataFrame:
    """Per key: n, mean, median and population deviation of the durations, and of each counter, which counts as 0 where missing."""
    out = [F.count("*").alias("n"), F.avg(duration).alias("mean"), F.median(duration).alias("median"), F.stddev_pop(duration).alias("stdev")]
    for c in counters:
        x = F.coalesce(F.col(c), F.lit(0))
        out += [F.avg(x).alias(f"{c}_mean"), F.median(x).alias(f"{c}_median"), F.stddev_pop(x).alias(f"{c}_stdev")]
    return rows.groupBy(*keys).agg(*out)


def merge_over_ranks(stats: DataFrame, loop: list[str], columns: list[str]) -> DataFrame:
    """Per loop the unweighted mean over ranks of each statistic."""
    return stats.groupBy(*loop).agg(F.count("*").alias("n_ranks"), *[F.avg(c).alias(c) for c in columns])


def histogram(rows: DataFrame, keys: list[str], value: str, low: float, step: float, buckets: int) -> DataFrame:
    """(keys, bucket, n): how many values fall in each bucket; the last takes what is above, values below ``low`` are left out."""
    bucket = F.least(F.floor((F.col(value) - low) / step), F.lit(buckets - 1))
    return rows.where(F.col(value) >= low).groupBy(*keys, bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def plane_statistics(cells: DataFrame, plane: str, row: str, values: str, rows: tuple[str, ...]) -> DataFrame:
    """Per plane the mean of the middle cells of each named row (first and last dropped), to 2 digits, a column a row."""
    middle = F.slice(values, 2, F.greatest(F.size(values) - 2, F.lit(0)))
    mean = F.aggregate(middle, F.lit(0.0), lambda s, x: s + x) / F.size(middle)
    return cells.withColumn("_m", F.round(mean, 2)).groupBy(plane).pivot(row, list(rows)).agg(F.first("_m"))


def csv_rows(stats: DataFrame, counters: list[str]) -> DataFrame:
    """The loop statistics report: loops of more than one iteration on average, a column a counter, empty where missing."""
    kept = stats.where("total_iters > 1")
    return kept.select(F.col("rank").alias("Rank"), F.col("loop_loc").alias("Loop loc."), F.col("total_iters").alias("Total iters"), F.col("iter_time_mean").alias("Iter time m"), F.col("iter_time_std").alias("Iter time std"), *[F.col("counter")[c].alias(f"{c}_mean") for c in counters])


def write_csv(stats: DataFrame, counters: list[str], path: str) -> None:
    csv_rows(stats, counters).write.option("header", True).mode("overwrite").csv(path)
