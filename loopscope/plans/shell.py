"""The same structure again under other filters, by short commands."""

from __future__ import annotations

import cmd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopscope.operators import nesting
from loopscope.plans import render
from loopscope.plans.inference import Structure


class Shell(cmd.Cmd):
    """Commands: ``pseudocode [default | wo-cs | ranks a,b | w-burst-info | w-burst-threshold x]``, ``show loop n``, ``clustering``, ``quit``."""

    prompt = "loopscope> "

    def __init__(self, structure: Structure, instants: DataFrame | None = None, **io):
        super().__init__(**io)
        self.structure, self.instants, self.filters = structure, instants, {}

    def do_pseudocode(self, arg: str) -> None:
        words = arg.split()
        if words[:1] == ["default"]:
            self.filters = {}
        elif words[:1] == ["wo-cs"]:
            self.filters["leaf_only"] = True
        elif words[:1] == ["ranks"] and len(words) == 2:
            self.filters["shown"] = [int(x) for x in words[1].split(",")]
        elif words[:1] == ["w-burst-info"]:
            self.filters["bursts"] = True
        elif words[:1] == ["w-burst-threshold"] and len(words) == 2:
            self.filters["least_burst"] = float(words[1])
        elif words:
            print(self.__doc__, file=self.stdout)
            return
        for r in render.rendered(self.structure, **self.filters).collect():
            print(r["text"].rstrip(), file=self.stdout)

    def do_clustering(self, arg: str) -> None:
        for r in self.structure.reduced.groupBy("cluster_id", "phase").agg(F.count("*").alias("n"), F.avg("gap_mean").alias("gap")).orderBy("cluster_id").collect():
            print(f"cluster {r['cluster_id']}: phase {r['phase']}, {r['n']} paths, mean gap {r['gap']:.6g}", file=self.stdout)

    def do_show(self, arg: str) -> None:
        loop, n = (int(x) for x in arg.split())
        print(iteration_range(self.structure, self.instants, loop, n), file=self.stdout)

    def do_quit(self, arg: str) -> bool:
        return True

    do_q = do_EOF = do_quit


def iteration_range(structure: Structure, occurrences: DataFrame, loop: int, n: int) -> tuple[int, int] | None:
    """From when to when the n-th iteration (from 0) of a loop ran, by its first and last call on its first rank."""
    items = structure.items.where(F.col("loop") == loop)
    bounds = items.agg(F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"), F.min(F.col("ranks")[0]).alias("rank")).first()
    if bounds["first"] is None:
        return None
    key = F.transform("path", lambda f: F.struct(f["fn"].alias("fn"), f["line"].alias("line")))
    rows = occurrences.where(F.col("rank") == bounds["rank"]).withColumn("key", key)
    of = lambda k: F.array(*[F.struct(F.lit(f["fn"]).alias("fn"), F.lit(f["line"]).alias("line")) for f in k])
    begins = rows.where(F.col("key") == of(bounds["first"])).select("rank", "t")
    ends = rows.where(F.col("key") == of(bounds["last"])).select("rank", F.col("t_out").alias("t"))
    found = nesting.iteration_bounds(begins, ends, ["rank"], "t").where(F.col("iteration") == n).first()
    return None if found is None else (found["t_begin"], found["t_end"])


def nth(rows: DataFrame, keys: list[str], t: str, n: int) -> DataFrame:
    """The n-th row (from 0) of each key by time."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(t)) - 1).where(F.col("_n") == n).drop("_n")
