"""Reduction of occurrences (rank, path, t, metrics) to one row per rank and path, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopscope.functions.scalars import cost


def reduce_paths(rows: DataFrame, keys: list[str], t: str, metrics: tuple[str, ...] = (), total: float | None = None, medians: bool = True) -> DataFrame:
    """Per key: n, t_first, t_last, gap_mean, gap_median and, for each metric, mean, population deviation, sum and percent of ``total``.

    The mean gap needs no order: it is the span over the gaps' number, so that one aggregate with
    partial sums serves. Only medians need the instants in order. One repetition has no gaps and no
    statistics.
    """
    several = F.col("n") > 1
    if medians:
        rows = rows.withColumn("_gap", F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t)))
    stats = [f for m in metrics for f in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_stdev"), F.sum(m).alias(f"{m}_sum"))]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(t).alias("t_first"), F.max(t).alias("t_last"), *([F.median("_gap").alias("_median")] if medians else []), *stats)
    out = [*keys, "n", "t_first", "t_last", F.when(several, (F.col("t_last") - F.col("t_first")) / (F.col("n") - 1)).alias("gap_mean")]
    out += [F.when(several, F.col("_median")).alias("gap_median")] if medians else []
    for m in metrics:
        out += [F.when(several, F.col(f"{m}_{s}")).alias(f"{m}_{s}") for s in ("mean", "stdev", "sum")]
        out += [F.when(several, F.col(f"{m}_sum") / total * 100).alias(f"{m}_percent")] if total else []
    return found.select(*out)


def total_time(rows: DataFrame, t: str) -> DataFrame:
    """One row with the run's length ``total``."""
    return rows.agg((F.max(t) - F.min(t)).alias("total"))


def explained_share(reduced: DataFrame, total: DataFrame) -> DataFrame:
    """Adds ``share``, the part of the run that a path explains: repetitions times mean gap over the total."""
    return reduced.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") * F.col("gap_mean") / F.col("total"))


def keep_above(shared: DataFrame, bound: float) -> DataFrame:
    """Repeated paths that explain more than ``bound`` of the run."""
    return shared.where((F.col("n") > 1) & (cost(F.col("n"), F.col("total"), F.col("gap_mean"), bound) > 0))


def at_share(shared: DataFrame, share: float) -> DataFrame:
    """Paths that explain just ``share`` of the run: whose cost there is nil."""
    return shared.where(cost(F.col("n"), F.col("total"), F.col("gap_mean"), share) == 0)


def share_between(shared: DataFrame, bottom: float, top: float) -> DataFrame:
    """Paths whose cost is over zero at the bottom share and not at the top one."""
    at = lambda s: cost(F.col("n"), F.col("total"), F.col("gap_mean"), s)
    return shared.where((at(bottom) > 0) & (at(top) <= 0))


def over_ranks(rows: DataFrame, path: list[str], rank: str, metrics: tuple[str, ...]) -> DataFrame:
    """Per path: its sorted ranks, their number, and of each metric the sum over ranks by their number (absent counts as 0)."""
    found = rows.groupBy(*path).agg(F.sort_array(F.collect_set(rank)).alias("ranks"), *[F.sum(m).alias(f"_{m}") for m in metrics])
    return found.select(*path, "ranks", F.size("ranks").alias("n_ranks"), *[(F.coalesce(F.col(f"_{m}"), F.lit(0)) / F.size("ranks")).alias(f"global_{m}") for m in metrics])


def ratio_rollup(rows: DataFrame, rank: str, numerator: str, denominator: str) -> DataFrame:
    """The ratio of means for each rank, and for all (rank null)."""
    return rows.rollup(rank).agg((F.avg(numerator) / F.avg(denominator)).alias("ratio"), F.stddev_pop(numerator).alias("spread"), F.count("*").alias("n"))


def mean_of_ratios(rows: DataFrame, rank: str, numerator: str, denominator: str) -> DataFrame:
    """The mean over ranks of each rank's ratio of means."""
    own = rows.groupBy(rank).agg((F.avg(numerator) / F.avg(denominator)).alias("r"))
    return own.agg(F.avg("r").alias("ratio"))


def probability(n: Column, iterations: Column) -> Column:
    """How often an iteration has a call; null where always."""
    return F.when(n < iterations, n / iterations)
