"""Flow between calls, and alignment of call stacks on a common frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(rows: DataFrame, rank: str, node: str, t: str, order: list[str]) -> DataFrame:
    """(src, dst, ranks, n): which node follows which, on which ranks and how often."""
    ahead = F.lead(node).over(Window.partitionBy(rank).orderBy(t, *order))
    found = rows.withColumn("dst", ahead).where(F.col("dst").isNotNull())
    return found.groupBy(F.col(node).alias("src"), "dst").agg(F.sort_array(F.collect_set(rank)).alias("ranks"), F.count("*").alias("n"))


def ends(edge: DataFrame) -> DataFrame:
    """(node, head, tail): whether nothing leads to a node, and nothing from it."""
    nodes = edge.select(F.col("src").alias("node")).union(edge.select("dst")).distinct()
    into, out = edge.where("src <> dst").select(F.col("dst").alias("node")).distinct(), edge.where("src <> dst").select(F.col("src").alias("node")).distinct()
    found = nodes.join(into.withColumn("_i", F.lit(True)), "node", "left").join(out.withColumn("_o", F.lit(True)), "node", "left")
    return found.select("node", F.col("_i").isNull().alias("head"), F.col("_o").isNull().alias("tail"))


def pivot(stacks: DataFrame, frames: str, order: str) -> DataFrame:
    """One row (frame, n): the frame that most stacks have, of equals the one seen first."""
    seen = stacks.select(order, F.explode(F.array_distinct(frames)).alias("frame"))
    counts = seen.groupBy("frame").agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = counts.agg(F.max(F.struct("n", (-F.col("_first")).alias("_f"), "frame")).alias("b"))
    return best.select(F.col("b.frame").alias("frame"), F.col("b.n").alias("n"))


def align(stacks: DataFrame, frames: str, frame: str) -> DataFrame:
    """Stacks that have ``frame`` with ``pad``, the places to shift them so that it is as high in all."""
    height = F.array_position(frames, frame)
    held = stacks.withColumn("height", height).where("height > 0")
    return held.crossJoin(F.broadcast(held.agg(F.max("height").alias("_most")))).withColumn("pad", (F.col("_most") - F.col("height")).cast("long")).drop("_most")


def place_rest(rest: DataFrame, aligned: DataFrame, frames: str, key: str) -> DataFrame:
    """(key, at, dropped): where a stack without the pivot fits, after dropping as few top frames as it takes, in an aligned one.

    A stack's suffixes meet the aligned stacks' runs as equal arrays, so that no pair is tried in vain.
    """
    runs = aligned.select(F.explode(F.expr(f"flatten(transform(sequence(1, size({frames})), i -> transform(sequence(1, size({frames}) - i + 1), n -> struct(slice({frames}, i, n) as run, i - 1 as at))))")).alias("r"), "pad")
    places = runs.groupBy(F.col("r.run").alias("run")).agg(F.min(F.col("r.at") + F.col("pad")).alias("at"))
    tails = rest.select(key, F.posexplode(F.expr(f"transform(sequence(1, size({frames})), i -> slice({frames}, i, size({frames})))")).alias("dropped", "run"))
    return tails.join(places, "run").groupBy(key).agg(F.min(F.struct("dropped", "at")).alias("b")).select(key, F.col("b.at").alias("at"), F.col("b.dropped").alias("dropped"))
