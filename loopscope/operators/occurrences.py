"""Occurrences of calls out of trace events: pairing, messages, counters and bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_instants(events: DataFrame, keys: list[str], t: str, order: str, values: list[str]) -> DataFrame:
    """One row per key and instant, with what its lines hold in the order of the lines."""
    item = F.struct(order, *values)
    found = events.groupBy(*keys, t).agg(F.sort_array(F.collect_list(item)).alias("_l"), F.count("*").alias("n_lines"))
    return found.select(*keys, t, "n_lines", *[F.col("_l").getField(v).alias(v) for v in values])


def backward_steps(rows: DataFrame, keys: list[str], order: str, t: str) -> DataFrame:
    """Rows whose time is before that of the row before them, which a trace must not have."""
    before = F.lag(t).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("t_before", before).where(F.col(t) < F.col("t_before"))


def pair_calls(marks: DataFrame, keys: list[str], t: str, order: list[str], is_entry: str) -> DataFrame:
    """(keys, t_in, t_out, duration): entries with the exit that follows them at once.

    An entry while another is open, and an exit with none open, pair with nothing; see ``unpaired``.
    """
    along = Window.partitionBy(*keys).orderBy(t, *order)
    ahead = marks.withColumn("t_out", F.lead(t).over(along)).withColumn("_next", F.lead(is_entry).over(along))
    found = ahead.where(F.col(is_entry) & ~F.col("_next"))
    return found.drop("_next").withColumnRenamed(t, "t_in").withColumn("duration", F.col("t_out") - F.col("t_in"))


def unpaired(marks: DataFrame, keys: list[str], t: str, order: list[str], is_entry: str) -> DataFrame:
    """Marks that break the turn of entries and exits."""
    along = Window.partitionBy(*keys).orderBy(t, *order)
    return marks.withColumn("_b", F.lag(is_entry).over(along)).where(F.col(is_entry) == F.coalesce("_b", F.lit(False))).drop("_b")


def match_messages(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """``calls`` (rank, t_in, t_out, ...) with msg_size and partners.

    A message belongs to the sender's call that starts when it is sent, and to the receiver's call
    that ends when it is received. Sizes of one call are summed, 0 if none; partners are sorted.
    ``messages``: (send_task, recv_task, t_send, t_recv, size).
    """
    sent = messages.select(F.col("send_task").alias("rank"), F.col("t_send").alias("_t"), F.lit("in").alias("_side"), F.col("recv_task").alias("_p"), "size")
    got = messages.select(F.col("recv_task").alias("rank"), F.col("t_recv").alias("_t"), F.lit("out").alias("_side"), F.col("send_task").alias("_p"), "size")
    sums = sent.unionByName(got).groupBy("rank", "_t", "_side").agg(F.sum("size").alias("_size"), F.sort_array(F.collect_set("_p")).alias("_p"))
    side = lambda s, n: sums.where(F.col("_side") == s).select("rank", F.col("_t").alias(f"t_{s}"), F.col("_size").alias(f"_size{n}"), F.col("_p").alias(f"_p{n}"))
    found = calls.join(side("in", 1), ["rank", "t_in"], "left").join(side("out", 2), ["rank", "t_out"], "left")
    none = F.array().cast("array<bigint>")
    size = F.coalesce("_size1", F.lit(0)) + F.coalesce("_size2", F.lit(0))
    partners = F.sort_array(F.array_union(F.coalesce(F.col("_p1").cast("array<bigint>"), none), F.coalesce(F.col("_p2").cast("array<bigint>"), none)))
    return found.select(*calls.columns, size.alias("msg_size"), partners.alias("partners"))


def attribute(counters: DataFrame, marks: DataFrame, keys: list[str], t: str, value: str, mode: str = "legacy") -> DataFrame:
    """(keys, scope, n, total): counter deltas within calls and in bursts between them.

    Counters of a record that also enters or leaves a call: in mode ``legacy`` those of the entry go
    to the call and those of the exit to the next burst; in ``shifted`` the deltas, which describe
    the time before their record, go to the burst before the entry and to the call that ends.
    ``marks`` holds (keys, t, is_entry).
    """
    rows = counters.select(*keys, F.col(t).alias("_t"), F.col(value).alias("_v"), F.lit(None).cast("boolean").alias("_m"), F.lit(1).alias("_o"))
    edge = marks.select(*keys, F.col(t).alias("_t"), F.lit(None).cast(counters.schema[value].dataType).alias("_v"), F.col("is_entry").alias("_m"), F.lit(0 if mode == "legacy" else 2).alias("_o"))
    before = F.last("_m", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0))
    scoped = rows.unionByName(edge).withColumn("_in", F.coalesce(before, F.lit(False))).where(F.col("_o") == 1)
    return scoped.groupBy(*keys, F.when(F.col("_in"), "call").otherwise("burst").alias("scope")).agg(F.count("*").alias("n"), F.sum("_v").alias("total"))


def bursts(calls: DataFrame, keys: list[str]) -> DataFrame:
    """``calls`` (t_in, t_out) with burst_ns, the time since the call before ended, or since the run began."""
    before = F.lag("t_out").over(Window.partitionBy(*keys).orderBy("t_in"))
    return calls.withColumn("burst_ns", F.col("t_in") - F.coalesce(before, F.lit(0)))


def since_outside(rows: DataFrame, keys: list[str], t: str, order: list[str], outside: str) -> DataFrame:
    """Adds ``gap``: the time since the last row before that was outside a call."""
    along = Window.partitionBy(*keys).orderBy(t, *order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("gap", F.col(t) - F.last(F.when(F.col(outside), F.col(t)), ignorenulls=True).over(along))


def iteration_counters(rows: DataFrame, keys: list[str], path: str, t: str, order: list[str], value: str) -> DataFrame:
    """Adds ``between``: what a counter adds up to from one occurrence of a path (inclusive) to its next (exclusive).

    A running sum along the key, taken at each occurrence less that at the one before.
    """
    along = Window.partitionBy(*keys).orderBy(t, *order)
    sums = rows.withColumn("_before", F.coalesce(F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.lag("_before").over(Window.partitionBy(*keys, path).orderBy(t, *order))
    return sums.withColumn("between", F.col("_before") - last).drop("_before")


def loop_stacks(calls: DataFrame, loops: DataFrame, keys: list[str], t: str) -> DataFrame:
    """``calls`` with loop_stack: the loops open at the call, outermost first. ``loops``: (keys, loop, level, t_in, t_out).

    Marks of loops and calls go along one line; at each level the last mark tells what is open.
    """
    ends = loops.select(*keys, "level", F.col("t_in").alias("_t"), F.col("loop").alias("_l"), F.lit(1).alias("_o")).unionByName(loops.select(*keys, "level", F.col("t_out").alias("_t"), F.lit(0).cast("long").alias("_l"), F.lit(0).alias("_o")))
    levels = [r["level"] for r in loops.select("level").distinct().orderBy("level").collect()]
    line = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    own = [c for c in calls.columns if c not in keys]
    both = calls.withColumn("_t", F.col(t)).withColumn("_o", F.lit(2)).withColumn("_call", F.lit(True)).unionByName(ends.withColumn("_call", F.lit(False)), allowMissingColumns=True)
    open_ = F.array(*[F.last(F.when(F.col("level") == v, F.col("_l")), ignorenulls=True).over(line) for v in levels]) if levels else F.array().cast("array<bigint>")
    return both.withColumn("loop_stack", F.filter(open_, lambda x: x.isNotNull() & (x != 0))).where("_call").select(*keys, *own, "loop_stack")
