"""From occurrences of calls to the loops that made them.

``occurrences``: rank, t, t_out, path (array of frames (fn, line, file), root first). Everything up to
the reduced table is distributed; the loops that come out of it are as many as the program has, so
their nesting, which depends on order, is decided on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopscope.functions import paths
from loopscope.operators import alias, clustering, nesting, phases, ranks, reduction


@dataclass(frozen=True)
class Structure:
    """``reduced``: a row per rank and path with phase and cluster; ``loops``: loop, parent, merged,
    cluster_id, phase, iterations, original_iterations, hidden, top_level; ``items``: a row per loop
    and path with its ranks, the mean of each metric, its frames' files and each rank's partners."""

    reduced: DataFrame
    loops: DataFrame
    items: DataFrame


#: Metrics of calls that are carried along where the occurrences have them.
METRICS = ("ins", "cyc", "burst_ns", "burst_ins", "burst_cyc", "send_size", "recv_size", "communicator", "msg_size")


def path_key():
    """What makes paths equal: functions and lines, not files."""
    return F.transform("path", lambda f: F.struct(f["fn"].alias("fn"), f["line"].alias("line")))


def infer(occurrences: DataFrame, *, bound: float = 0.01, phase_radius: float = 0.1, eps: float = 0.1, mode: str = "all", total: float | None = None, metrics: tuple[str, ...] | None = None) -> Structure:
    """Loops of a trace. ``metrics`` are columns of the occurrences, those of METRICS that they have if not given. ``total`` is the run's length, that of the occurrences if not given; ``mode`` is that of ``contains``."""
    rows = occurrences.withColumn("key", path_key()).withColumn("duration", F.col("t_out") - F.col("t"))
    of = ("duration", *(m for m in (METRICS if metrics is None else metrics) if m in rows.columns))
    totals = reduction.total_time(rows, "t") if total is None else rows.sparkSession.createDataFrame([(float(total),)], "total double")
    reduced = reduction.reduce_paths(rows, ["rank", "key"], "t", of)
    shared = reduction.keep_above(reduction.explained_share(reduced, totals), bound)
    found = phases.phases(shared, phase_radius)
    points = clustering.normalise(found, {"n": "x", "gap_mean": "y"})
    numbered = clustering.in_first_member_order(clustering.eps_components(points, "x", "y", eps), "component", F.struct("t_first", "rank", "key"))
    # A path of several ranks may end up in several clusters; each row stays in its own.
    members = numbered.drop("x", "y", "component").cache()
    instants = rows.select("rank", "key", "t", "t_out").join(members.select("rank", "key", "cluster_id"), ["rank", "key"])
    keys = ["cluster_id", "rank"]
    matrix = alias.wrap_columns(instants.select(*keys, "key", "t"), keys, "key", "t")
    blocks = alias.dense_blocks(alias.dense_runs(matrix, keys), keys)
    is_aliased, hidden = alias.aliased(matrix, keys), alias.superloops(blocks, keys)
    # Rows of one aliased matrix that share blocks are a sub-loop, numbered by its first row.
    first = Window.partitionBy(*keys)
    rows_of = alias.dense_runs(matrix, keys).groupBy(*keys, "row").agg(F.min(F.struct("c0", "c1")).alias("s"))
    along = first.orderBy("row")
    new = F.coalesce((F.col("s") != F.lag("s").over(along)).cast("int"), F.lit(0))
    subs = rows_of.withColumn("_n", new).withColumn("sub", F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, "row", "sub")
    where = matrix.select(*keys, "key", "row").distinct().join(subs, [*keys, "row"]).join(is_aliased, keys).join(hidden.select(*keys, "iterations", "hidden"), keys)
    where = where.withColumn("sub", F.when(F.col("aliased"), F.col("sub")).otherwise(F.lit(0))).withColumn("times", F.when(F.col("aliased") & F.col("hidden"), F.col("iterations")).otherwise(F.lit(1)))
    placed = members.join(where.select(*keys, "key", "sub", "times"), [*keys, "key"]).cache()

    parts = placed.groupBy("cluster_id", "sub").agg(F.min_by("n", F.struct("t_first", "rank", "key")).alias("n"), F.min_by("key", F.struct("t_first", "rank", "key")).alias("first_key"), F.min_by("rank", F.struct("t_first", "rank", "key")).alias("first_rank"), F.max("times").alias("times"), F.avg("gap_mean").alias("gap"), F.min_by("phase", F.struct("t_first", "rank", "key")).alias("phase"))
    listed = parts.orderBy("cluster_id", "sub").collect()
    spark = rows.sparkSession
    loops, numbers = [], {}
    for r in listed:
        numbers[r["cluster_id"], r["sub"]] = len(loops)
        loops.append({"id": len(loops), "cluster_id": r["cluster_id"], "phase": r["phase"], "iterations": int(r["n"]), "gap": r["gap"], "hidden": False, "times": r["times"], "first_key": r["first_key"], "first_rank": r["first_rank"], "inside": None})
    for cluster in sorted({x["cluster_id"] for x in loops if x["times"] > 1}):
        inside = [x for x in loops if x["cluster_id"] == cluster]
        number = len(loops)
        loops.append(inside[0] | {"id": number, "iterations": max(x["times"] for x in inside), "gap": inside[0]["gap"] * inside[0]["iterations"] / inside[0]["times"], "hidden": True, "inside": None})
        for x in inside:
            x["inside"] = number
    named = spark.createDataFrame([(c, s, i) for (c, s), i in numbers.items()], "cluster_id long, sub long, loop int")
    own = placed.join(F.broadcast(named), ["cluster_id", "sub"])
    moved = _conditioned(spark, own, loops)
    if moved:
        to = spark.createDataFrame(moved, own.select("loop", "key", F.col("loop").alias("to")).schema)
        own = own.join(F.broadcast(to), ["loop", "key"], "left").withColumn("loop", F.coalesce("to", "loop")).drop("to").cache()
        left = {r["loop"] for r in own.select("loop").distinct().collect()}
        loops = [x for x in loops if x["hidden"] or x["id"] in left]
    nested = _nest(spark, instants, loops, mode)
    schema = "loop int, parent int, merged boolean, cluster_id long, phase double, iterations double, original_iterations long, hidden boolean, top_level boolean"
    table = spark.createDataFrame([(x["id"], x["parent"], x["merged"], x["cluster_id"], x["phase"], x["iterations"], x["original"], x["hidden"], x["parent"] is None) for x in nested], schema)
    one = ranks.compact(own, ["loop"], "key", "rank", "t_first")
    stats = own.groupBy("loop", "key").agg(F.avg("n").alias("n"), *[F.avg(f"{m}_mean").alias(f"{m}_mean") for m in of])
    items = one.join(stats, ["loop", "key"])
    if "file" in rows.schema["path"].dataType.elementType.names:
        items = items.join(rows.groupBy("key").agg(F.min(F.transform("path", lambda f: f["file"])).alias("files")), "key", "left")
    if "partners" in rows.columns:
        met = rows.select("key", "rank", F.explode("partners").alias("p")).groupBy("key", "rank").agg(F.sort_array(F.collect_set("p")).alias("partners"))
        items = items.join(met.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "partners"))).alias("partners")), "key", "left")
    return Structure(members, table, items)


def _conditioned(spark, own: DataFrame, loops: list[dict]) -> list[tuple]:
    """(loop, key, to): calls that a condition on data keeps from some iterations.

    Such a call has fewer iterations than a loop of its phase between whose first and last lines it
    stands; a call of a loop around that one stands before or after it.
    """
    free = [(x["id"], float(x["phase"]), x["iterations"]) for x in loops if not x["hidden"] and x["inside"] is None]
    if len(free) < 2:
        return []
    listed = spark.createDataFrame(free, "loop int, phase double, its long")
    lined = own.select("loop", "key", F.transform("key", lambda f: f["line"]).alias("lines")).distinct().join(F.broadcast(listed), "loop")
    targets = lined.groupBy("phase", "loop").agg(F.min("lines").alias("first_line"), F.max("lines").alias("last_line"), F.first("its").alias("loop_iterations"))
    calls = lined.withColumnRenamed("loop", "of")
    return [(r["of"], r["key"], r["loop"]) for r in nesting.push_back(calls, targets, "phase", "lines", "its", fewer=True).collect()]


def _nest(spark, instants: DataFrame, loops: list[dict], mode: str) -> list[dict]:
    """Parents and iterations of all loops, phase by phase."""
    firsts = spark.createDataFrame([(x["id"], x["first_rank"], x["first_key"], x["times"] if x["hidden"] else 0, x["iterations"]) for x in loops], "loop int, rank int, key array<struct<fn:string,line:int>>, times long, iterations long") if loops else None
    contained: set[tuple[int, int]] = set()
    if loops:
        own = instants.select("rank", "key", "t").join(F.broadcast(firsts), ["rank", "key"])
        # Of a hidden loop every k-th instant of its first sub-loop counts.
        along = Window.partitionBy("loop").orderBy("t")
        step = F.greatest((F.count("*").over(Window.partitionBy("loop")) / F.greatest("times", F.lit(1))).cast("long"), F.lit(1))
        own = own.withColumn("_n", F.row_number().over(along) - 1).withColumn("_s", F.when(F.col("times") > 0, step).otherwise(1)).where("_n % _s = 0").select("loop", "t").cache()
        pairs = [(i["id"], o["id"]) for i in loops for o in loops if i["phase"] == o["phase"] and i["gap"] < o["gap"] and i is not o]
        if pairs:
            wanted = spark.createDataFrame(pairs, "inner int, outer int")
            outer = wanted.join(own, F.col("outer") == F.col("loop")).select("inner", "outer", "t")
            inner = wanted.join(own, F.col("inner") == F.col("loop")).select("inner", "outer", "t")
            contained = {(r["inner"], r["outer"]) for r in nesting.contains(outer, inner, ["inner", "outer"], "t", mode).where("contained").collect()}
    out = []
    for phase in sorted({x["phase"] for x in loops}):
        free = [x for x in loops if x["phase"] == phase and x["inside"] is None]
        out += [x | {"original": next(y["iterations"] for y in loops if y["id"] == x["id"])} for x in nesting.nest(free, contained)]
    for x in loops:
        if x["inside"] is not None:
            out.append(x | {"parent": x["inside"], "merged": False, "original": x["iterations"], "iterations": x["iterations"] / x["times"]})
    return sorted(out, key=lambda x: x["id"])


def shifted(items: DataFrame) -> DataFrame:
    """``items`` with each frame at the line that calls it."""
    lines = F.transform("key", lambda f: f["line"])
    moved = paths.line_shift(lines)
    return items.withColumn("key", F.transform(F.arrays_zip("key", moved.alias("l")), lambda x: F.struct(x["key"]["fn"].alias("fn"), x["l"].alias("line"))))
