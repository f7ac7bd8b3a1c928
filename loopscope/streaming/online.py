"""The reduction and what belongs to it over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduce_online(events: DataFrame, keys: list[str], t: str, value: str | None = None) -> DataFrame:
    """Per key: n, t_first, t_last, gap_mean and, for ``value``, sum, mean and population deviation.

    All of it comes from counts, sums and bounds, so a stream keeps one small state a key (use
    update or complete mode) and gives what the batch gives.
    """
    out = [F.count("*").alias("n"), F.min(t).alias("t_first"), F.max(t).alias("t_last")]
    if value:
        out += [F.sum(value).alias(f"{value}_sum"), F.avg(value).alias(f"{value}_mean"), F.stddev_pop(value).alias(f"{value}_stdev")]
    found = events.groupBy(*keys).agg(*out)
    return found.withColumn("gap_mean", F.when(F.col("n") > 1, (F.col("t_last") - F.col("t_first")) / (F.col("n") - 1)))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Bursts of each rank: events less than ``gap`` apart. (rank, t_first, n, cents), by event time ``ts``."""
    rows = events.withWatermark("ts", late) if late else events
    found = rows.groupBy("rank", F.session_window("ts", gap).alias("w")).agg(F.min("t").alias("t_first"), F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return found.drop("w")


def windows(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, path, n, cents) of tumbling or sliding windows."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w"), "path").agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).select(F.col("w.start").alias("start"), "path", "n", "cents")


def match_messages(sends: DataFrame, receives: DataFrame, late: str, apart: str) -> DataFrame:
    """Stream-stream outer join of the two sides of messages by ``message``, both with event time ``ts``.

    A side whose other has not come by the time ``late`` and ``apart`` have passed is given alone, and its state goes.
    """
    s = sends.withWatermark("ts", late).select(F.col("message").alias("_m"), F.col("ts").alias("sent"), F.col("task").alias("send_task"))
    r = receives.withWatermark("ts", late).select("message", F.col("ts").alias("received"), F.col("task").alias("recv_task"))
    near = F.expr(f"received >= sent and received <= sent + interval {apart}")
    return s.join(r, (F.col("_m") == F.col("message")) & near, "full_outer").select(F.coalesce("message", "_m").alias("message"), "send_task", "recv_task", "sent", "received")


def kept_by_sampling(rows: DataFrame, alpha: float, path: str) -> DataFrame:
    """Iterations that sampling at the source keeps, each with probability ``alpha``, a nested one only if all around it are kept.

    ``path`` is the array of the keys of an iteration and those around it, outermost first. Each is
    drawn by the hash of its own path, so that all that is nested in one sees the same draw.
    """
    steps = F.sequence(F.lit(1), F.size(path))
    draw = lambda k: F.conv(F.substring(F.md5(F.array_join(F.slice(path, 1, k), "/")), 1, 8), 16, 10).cast("long")
    return rows.where((F.size(path) > 0) & F.forall(steps, lambda k: draw(k) < F.lit(int(alpha * (1 << 32)))))
