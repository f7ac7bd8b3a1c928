"""Same behaviour on several ranks, and the conditions that set ranks apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compact(items: DataFrame, keys: list[str], path: str, rank: str, order: str, is_loop: str | None = None) -> DataFrame:
    """Per key and path: its ranks and first place. A nested loop starts a new stretch, beyond which paths don't merge."""
    rows = items
    if is_loop:
        rows = rows.withColumn("segment", F.sum(F.col(is_loop).cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows = rows.withColumn("segment", F.lit(0))
    return rows.groupBy(*keys, "segment", path).agg(F.sort_array(F.collect_set(rank)).alias("ranks"), F.size(F.collect_set(rank)).alias("n_ranks"), F.min(order).alias("place"))


def flat_blocks(rows: DataFrame, order: str, ranks: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, block, ranks, n_items, first, last): neighbours with the same ranks make one block."""
    keys = keys or []
    along = Window.partitionBy(*keys).orderBy(order)
    new = rows.withColumn("_new", F.coalesce((~(F.col(ranks) == F.lag(ranks).over(along))).cast("int"), F.lit(0)))
    numbered = new.withColumn("block", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "block", ranks).agg(F.count("*").alias("n_items"), F.min(order).alias("first"), F.max(order).alias("last"))


def nested_blocks(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, block): the path of blocks that each item (pos, ranks) is in, as an array of numbers.

    Items go in order. One with the ranks of an open block joins it; one whose ranks are a part of
    an open block's opens a block within it; other blocks close. A loop's items are few, so that a
    group is one loop.
    """

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame, paths, open_, made = frame.sort_values("pos"), [], [], {}
        everyone = frozenset(r for x in frame["ranks"] for r in x)
        for own in map(frozenset, frame["ranks"]):
            while open_ and not own <= open_[-1][0]:
                open_.pop()
            if own != (open_[-1][0] if open_ else everyone):
                path = open_[-1][1] if open_ else ()
                made[path] = made.get(path, -1) + 1
                open_.append((own, (*path, made[path])))
            paths.append(list(open_[-1][1]) if open_ else [])
        return frame[keys + ["pos"]].assign(block=paths)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*keys, "pos").schema)
    return items.select(*keys, "pos", "ranks").groupBy(*keys).applyInPandas(place, f"{schema}, block array<int>")
