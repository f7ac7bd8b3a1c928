"""Nesting of loops by their instants, and calls pushed into the loops that they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inner_per_interval(outer: DataFrame, inner: DataFrame, keys: list[str], t: str) -> DataFrame:
    """(keys, interval, n_inner): for each interval between consecutive outer instants, from 1, the inner instants strictly inside it.

    Both sides are laid along one line per key; an inner instant belongs to the outer one last
    seen, so that no range join is needed. Instants on a bound are in no interval.
    """
    both = outer.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_outer")).unionByName(inner.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_outer")))
    line = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    marked = both.withColumn("interval", F.sum("_outer").over(line)).withColumn("_on", F.max("_outer").over(Window.partitionBy(*keys, "_t")))
    counts = marked.groupBy(*keys, "interval").agg(F.sum(F.when((F.col("_outer") == 0) & (F.col("_on") == 0), 1).otherwise(0)).alias("n_inner"))
    last = Window.partitionBy(*keys)
    return counts.where("interval >= 1").withColumn("_last", F.max("interval").over(last)).where("interval < _last").drop("_last")


def contains(outer: DataFrame, inner: DataFrame, keys: list[str], t: str, mode: str = "all") -> DataFrame:
    """(keys, n_intervals, n_hit, contained): whether ``all`` (or ``any``) intervals of the outer loop hold an instant of the inner one."""
    found = inner_per_interval(outer, inner, keys, t).groupBy(*keys).agg(F.count("*").alias("n_intervals"), F.sum((F.col("n_inner") > 0).cast("int")).alias("n_hit"))
    rule = F.col("n_hit") == F.col("n_intervals") if mode == "all" else F.col("n_hit") > 0
    return found.withColumn("contained", rule)


def thin(rows: DataFrame, keys: list[str], t: str, k: int) -> DataFrame:
    """Every k-th instant of each key, the first one first."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(t))).where((F.col("_n") - 1) % k == 0).drop("_n")


def iteration_bounds(begins: DataFrame, ends: DataFrame, keys: list[str], t: str) -> DataFrame:
    """(keys, iteration, t_begin, t_end): starts of a loop's first call paired by number with ends of its last, the longer list thinned to the shorter one's step."""
    along = Window.partitionBy(*keys)

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, F.col(t).alias(name), (F.row_number().over(along.orderBy(t)) - 1).alias("_k"), F.count("*").over(along).alias(f"_n_{name}"))

    sizes = begins.groupBy(*keys).agg(F.count("*").alias("_b")).join(ends.groupBy(*keys).agg(F.count("*").alias("_e")), keys)
    steps = sizes.select(*keys, F.greatest(F.floor(F.col("_b") / F.col("_e")), F.lit(1)).alias("_sb"), F.greatest(F.floor(F.col("_e") / F.col("_b")), F.lit(1)).alias("_se"))

    def thinned(rows: DataFrame, name: str, step: str) -> DataFrame:
        return numbered(rows, name).join(steps, keys).where(F.col("_k") % F.col(step) == 0).select(*keys, name, (F.col("_k") / F.col(step)).cast("long").alias("iteration"))

    return thinned(begins, "t_begin", "_sb").join(thinned(ends, "t_end", "_se"), [*keys, "iteration"])


def nearest_parent(pairs: DataFrame, child: str, parent: str) -> DataFrame:
    """For each child the first of the later loops that contain it."""
    return pairs.where(F.col(parent) > F.col(child)).groupBy(child).agg(F.min(parent).alias("parent"))


def push_back(calls: DataFrame, loops: DataFrame, phase: str, line: str, iterations: str, *, fewer: bool = False) -> DataFrame:
    """(calls' columns, loop): the loop of the same phase, of other iterations, between whose first and last line a call lies.

    With ``fewer`` only calls of fewer iterations than the loop's are taken. Of several, the one with the fewest iterations takes it, then that of the smallest number.
    """
    other = F.col(iterations) < F.col("loop_iterations") if fewer else F.col(iterations) != F.col("loop_iterations")
    fits = (F.col(line) > F.col("first_line")) & (F.col(line) < F.col("last_line")) & other
    found = calls.join(loops, phase).where(fits)
    return found.groupBy(*calls.columns).agg(F.min(F.struct("loop_iterations", "loop")).alias("_l")).select(*calls.columns, F.col("_l.loop").alias("loop"))


def merge_iterations(outer: int, inner: int) -> tuple[float, bool]:
    """The iterations of a loop once inside another, and whether it dissolves in it (equal counts)."""
    return (inner / outer, inner == outer)


def nest(loops: list[dict], contained: set[tuple[int, int]]) -> list[dict]:
    """Parents and iterations of a phase's loops, by ascending mean gap.

    ``loops`` (id, iterations, gap) are a phase's, a few hundred at most; ``contained`` holds the
    (inner, outer) pairs found by ``contains``. Each loop goes into the first later one that takes
    it; what no loop takes stays at the top.
    """
    order = sorted(loops, key=lambda x: (x["gap"], x["id"]))
    out = []
    for i, inner in enumerate(order):
        parent = next((o for o in order[i + 1 :] if o["iterations"] == inner["iterations"] or (inner["id"], o["id"]) in contained), None)
        if parent is None:
            out.append(inner | {"parent": None, "merged": False, "iterations": float(inner["iterations"])})
        else:
            n, same = merge_iterations(parent["iterations"], inner["iterations"])
            out.append(inner | {"parent": parent["id"], "merged": same, "iterations": n})
    return out
