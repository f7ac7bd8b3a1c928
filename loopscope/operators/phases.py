"""Phases: density clusters of the explained share, and curves of equal share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopscope.functions.scalars import cost


def islands(rows: DataFrame, x: str, radius: float, out: str = "phase_id") -> DataFrame:
    """Adds the number of each row's island: values of which neighbours are at most ``radius`` apart.

    Values in one cell as wide as the radius are connected, so only each cell's ends are put in
    order: as many rows as the range holds radii, whatever the number of values.
    """
    cell = F.floor(F.col(x) / F.lit(radius))
    cells = rows.where(F.col(x).isNotNull()).groupBy(cell.alias("_cell")).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    along = Window.orderBy("_cell")
    new = (F.col("_lo") - F.lag("_hi").over(along) > radius).cast("int")
    numbered = cells.withColumn("_new", F.coalesce(new, F.lit(0))).select("_cell", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias(out))
    return rows.withColumn("_at", cell).join(numbered, F.col("_at") == F.col("_cell"), "left").drop("_at", "_cell")


def phases(shared: DataFrame, radius: float = 0.1, digits: int = 2) -> DataFrame:
    """Adds ``phase_id`` and ``phase``, the mean share of the island, rounded."""
    rows = islands(shared, "share", radius)
    values = rows.groupBy("phase_id").agg(F.round(F.avg("share"), digits).alias("phase"))
    return rows.join(values, "phase_id", "left")


def best_share(shared: DataFrame, step: float = 0.01) -> DataFrame:
    """The one share, in steps, that costs least on average: one row (share, mean_cost). Each path meets a fixed grid."""
    n = round(1 / step)
    grid = F.explode(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.round(k * step, 6)))
    costs = shared.where("n > 1").withColumn("grid", grid).groupBy("grid").agg(F.avg(F.abs(cost(F.col("n"), F.col("total"), F.col("gap_mean"), F.col("grid")))).alias("mean_cost"))
    return costs.withColumn("mean_cost", F.round("mean_cost", 6)).agg(F.min(F.struct("mean_cost", "grid")).alias("b")).select(F.col("b.grid").alias("share"), F.col("b.mean_cost").alias("mean_cost"))


def near_distance(x: Column, y: Column, c: Column, steps: int = 2) -> Column:
    """About how far (x, y) is from the curve x * y = c: the height of the right triangle that the
    curve's points above and beside it span, halved along the hypotenuse in each further step."""
    for _ in range(steps - 1):
        px, py = c / y, c / x
        mx, my = (x + px) / 2, (y + py) / 2
        x, y = F.when(F.abs(x * y - c) < 1e-12, x).otherwise((x + mx) / 2), F.when(F.abs(x * y - c) < 1e-12, y).otherwise((y + my) / 2)
    a, b = F.abs(x - c / y), F.abs(y - c / x)
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(a * b / F.sqrt(a * a + b * b))


def exact_distance(x: Column, y: Column, c: Column) -> Column:
    """How far (x, y) is from x * y = c, by the real roots of 2u^4 - 2xu^3 + 2ycu - 2c^2."""

    @F.pandas_udf("double")
    def nearest_root(x: pd.Series, y: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for a, b, k in zip(x, y, c, strict=True):
            roots = np.roots([2, -2 * a, 0, 2 * b * k, -2 * k * k])
            u = roots[(np.abs(roots.imag) < 1e-6 * (1 + np.abs(roots))) & (roots.real > 0)].real
            out.append(float(np.sqrt(np.min((u - a) ** 2 + (k / u - b) ** 2))) if len(u) else None)
        return pd.Series(out, dtype="float64")

    return nearest_root(x, y, c)


def near_points(points: DataFrame, distance: str, epsilon: float) -> DataFrame:
    """One row: how many points are within epsilon and their mean squared distance."""
    return points.where(F.col(distance) <= epsilon).agg(F.count("*").alias("n"), F.avg(F.col(distance) ** 2).alias("mean_square"))


def fit_shares(points: DataFrame, total: float, candidates: list[float], most: float = 1.0) -> list[float]:
    """Shares, adding up to ``most`` at most, whose curves lie nearest to all points.

    The distance of every point to every candidate is summed where the points are; for the choice
    only sums over points come to the driver, one step per share taken: the candidate that lowers
    the sum of nearest distances most, as long as it does by more than 1.
    """
    at = F.array(*[near_distance(F.col("n").cast("double"), F.col("gap_mean"), F.lit(s * total)) for s in candidates])
    rows, taken, known = points.select(at.alias("d")).persist(), [], None
    try:
        while True:
            free = [k for k in range(len(candidates)) if k not in taken and sum(candidates[i] for i in [*taken, k]) <= most + 1e-9]
            if not free:
                break
            sums = rows.agg(*[F.sum(F.least(*[F.col("d")[i] for i in [*taken, k]]) if taken else F.col("d")[k]).alias(str(k)) for k in free]).first()
            k = min(free, key=lambda i: (sums[str(i)] if sums[str(i)] is not None else 0.0, i))
            if sums[str(k)] is None or known is not None and known - sums[str(k)] <= 1:
                break
            taken, known = [*taken, k], sums[str(k)]
    finally:
        rows.unpersist()
    return sorted(candidates[k] for k in taken)


def curve(shares: DataFrame, share: str, total: float | Column, y_from: float, y_to: float, samples: int) -> DataFrame:
    """Points of each share's curve: y in equal steps, x = share * total / y."""
    y = F.lit(y_from) + F.col("i") * F.lit((y_to - y_from) / (samples - 1))
    return shares.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("y", y).withColumn("x", F.col(share) * (total if isinstance(total, Column) else F.lit(total)) / F.col("y"))
