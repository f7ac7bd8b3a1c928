"""Loop clusters: density clusters of (repetitions, mean gap), with one point making a cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalise(points: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds each column over its largest value, under the new name."""
    largest = points.agg(*[F.max(c).alias(f"_max_{c}") for c in columns])
    return points.crossJoin(F.broadcast(largest)).withColumns({new: F.col(c) / F.col(f"_max_{c}") for c, new in columns.items()}).drop(*[f"_max_{c}" for c in columns])


def normalise_jointly(sets: list[DataFrame], columns: dict[str, str]) -> list[DataFrame]:
    """Several sets, each column over its largest value in all of them."""
    every = None
    for points in sets:
        own = points.select(*columns)
        every = own if every is None else every.unionByName(own)
    largest = every.agg(*[F.max(c).alias(f"_max_{c}") for c in columns])
    return [points.crossJoin(F.broadcast(largest)).withColumns({new: F.col(c) / F.col(f"_max_{c}") for c, new in columns.items()}).drop(*[f"_max_{c}" for c in columns]) for points in sets]


def eps_components(points: DataFrame, x: str, y: str, eps: float, out: str = "component") -> DataFrame:
    """Adds the component of each point (a number) under "at most eps apart".

    Points in one cell of side eps / sqrt(2) are connected, so components are those of cells, whose
    number the normalised plane bounds at 2 / eps^2; only cells and their links come to the driver.
    A pair of cells is linked if any two points of theirs are near; each point meets the cells
    around it, and equal points count once.
    """
    side = eps / math.sqrt(2)
    cell_of = lambda a, b: F.struct(F.floor(F.col(a) / side).alias("i"), F.floor(F.col(b) / side).alias("j"))
    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("px"), F.col(y).alias("py")).distinct().withColumn("cell", cell_of("px", "py"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)])
    sent = own.withColumn("s", F.explode(steps)).select("px", "py", F.col("cell").alias("of"), F.struct((F.col("cell.i") + F.col("s.a")).alias("i"), (F.col("cell.j") + F.col("s.b")).alias("j")).alias("cell"))
    near = sent.join(own.select("cell", F.col("px").alias("qx"), F.col("py").alias("qy")), "cell").where((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2 <= eps * eps)
    links = near.select("of", "cell").distinct().collect()
    parent = {(r["cell"]["i"], r["cell"]["j"]): (r["cell"]["i"], r["cell"]["j"]) for r in own.select("cell").distinct().collect()}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    for r in links:
        a, b = sorted((root(tuple(r["of"])), root(tuple(r["cell"]))))
        parent[b] = a
    number = {c: k for k, c in enumerate(sorted({root(c) for c in parent}))}
    named = points.sparkSession.createDataFrame([(i, j, number[root((i, j))]) for i, j in parent] or [], f"_i long, _j long, {out} int")
    return points.withColumn("_c", cell_of(x, y)).join(F.broadcast(named), (F.col("_c.i") == F.col("_i")) & (F.col("_c.j") == F.col("_j")), "left").drop("_c", "_i", "_j")


def in_first_member_order(rows: DataFrame, component: str, order: str, out: str = "cluster_id") -> DataFrame:
    """Adds cluster numbers, from 0, that follow each component's first member."""
    firsts = rows.groupBy(component).agg(F.min(order).alias("_first"))
    numbers = firsts.select(component, (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias(out))
    return rows.join(F.broadcast(numbers), component)


def by_loop(rows: DataFrame, stack: str, out: str = "cluster_id") -> DataFrame:
    """Clusters by the loops that rows are known to be in, instead of by density."""
    stacks = rows.select(stack).distinct()
    return rows.join(F.broadcast(stacks.withColumn(out, (F.dense_rank().over(Window.orderBy(stack)) - 1).cast("long"))), stack)


def summary(rows: DataFrame, cluster: str, order: str, phase: str = "phase") -> DataFrame:
    """Per cluster: members, phase (its first member's), mean of the mean and median gaps."""
    return rows.groupBy(cluster).agg(F.count("*").alias("members"), F.min_by(phase, order).alias("phase"), F.avg("gap_mean").alias("gap_mean"), F.avg("gap_median").alias("gap_median"))


def purity(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """Per cluster whether all members have one label."""
    return rows.groupBy(cluster).agg(F.count("*").alias("members"), (F.countDistinct(label) == 1).alias("pure"))
