"""From decoded trace events to calls: what a record holds, and the call that two records make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopscope.functions import paths
from loopscope.operators import occurrences
from loopscope.sources.trace import COMMUNICATOR, RECV_SIZE, SEND_SIZE, call_name, line_parts

#: The counters of instructions and of cycles.
INSTRUCTIONS, CYCLES = "42000050", "42000059"


def records_of(events: DataFrame) -> DataFrame:
    """A row per task and instant: (rank, t, mpi, call, frames, ins, cyc, send_size, recv_size, communicator).

    ``events`` (task, t, line_no, pos, type, value, family, label) can hold several lines of one
    instant; they count as one record in the order of the lines. ``mpi`` is null outside calls' ends,
    0 at an exit; frames are zipped from lines and callers by place, root first and cut at main.
    """
    of = lambda family: F.col("family") == family
    counter = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("value")))
    size = lambda kind: F.max(F.when(F.col("type") == kind, F.col("value")))
    listed = lambda family, *x: F.sort_array(F.collect_list(F.when(of(family), F.struct("line_no", "pos", *x))))
    # A label that the dictionary lacks says nothing of a line but its number.
    named, part = F.col("label") != F.concat_ws("_", "type", F.col("value").cast("string")), line_parts(F.col("label"))
    line, file = F.coalesce(F.when(named, part["line"].cast("long")), F.col("value")).alias("line"), F.when(named, part["file"]).alias("file")
    found = events.groupBy((F.col("task") - 1).alias("rank"), "t").agg(
        F.max(F.when(of("MPI"), F.col("value"))).alias("mpi"),
        F.max(F.when(of("MPI") & (F.col("value") != 0), F.col("label"))).alias("call"),
        listed("CALL", call_name(F.col("label")).alias("fn")).alias("c"),
        listed("LINE", line, file).alias("l"),
        counter(INSTRUCTIONS).alias("ins"), counter(CYCLES).alias("cyc"), size(SEND_SIZE).alias("send_size"), size(RECV_SIZE).alias("recv_size"), size(COMMUNICATOR).alias("communicator"),
    )
    return found.withColumn("frames", paths.frames_of(F.col("c.fn"), F.col("l.line"), F.col("l.file"))).drop("c", "l")


def leaf(call: Column) -> Column:
    """The last frame of a call's path."""
    return F.struct(call.alias("fn"), F.lit(0).alias("line"), F.lit("libmpi").alias("file"))


def calls_of(records: DataFrame) -> DataFrame:
    """(rank, t, t_out, path, ins, cyc, burst_ns, burst_ins, burst_cyc, send_size, recv_size, communicator): a row per call.

    Counters and sizes of a call are those of the record that enters it; those of the burst before
    it, and its length, count from the last record outside calls. Where entries and exits don't
    take turns, nothing is made (see ``occurrences.unpaired``).
    """
    along = Window.partitionBy("rank").orderBy("t")
    ended = F.coalesce(F.last("mpi", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 0
    outside = F.when(F.col("ended") & F.coalesce("ins", "cyc", "mpi").isNotNull(), F.struct("t", "ins", "cyc"))
    rows = records.withColumn("ended", ended).withColumn("before", F.last(outside, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    marks = rows.where("mpi is not null").withColumn("t_out", F.lead("t").over(along)).withColumn("next", F.lead("mpi").over(along))
    path = F.concat("frames", F.array(leaf(F.col("call"))))
    burst = [(F.col("t") - F.coalesce("before.t", F.lit(0))).alias("burst_ns"), F.col("before.ins").alias("burst_ins"), F.col("before.cyc").alias("burst_cyc")]
    return marks.where((F.col("mpi") != 0) & (F.col("next") == 0)).select("rank", "t", "t_out", path.alias("path"), "ins", "cyc", *burst, "send_size", "recv_size", "communicator")


def with_messages(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """``calls`` with msg_size and partners, ranks from 0; a call without messages has the size 0 and the partner -1."""
    zero = messages.select(*[(F.col(c) - 1).alias(c) if c in ("send_task", "recv_task") else F.col(c) for c in ("send_task", "recv_task", "t_send", "t_recv", "size")])
    found = occurrences.match_messages(calls.withColumnRenamed("t", "t_in"), zero).withColumnRenamed("t_in", "t")
    return found.withColumn("partners", F.when(F.size("partners") == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.col("partners")))


def occurrences_of(events: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """The calls of a trace's labelled events, with what its messages say of them: the input of ``inference.infer``."""
    calls = calls_of(records_of(events))
    return calls if messages is None else with_messages(calls, messages)
