"""Column functions over call paths: arrays of frames, root first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lcp_length(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.when(x["a"].eqNullSafe(x["b"]), None).otherwise(i)), lambda i: i.isNotNull())
    return F.when(n <= 0, F.lit(0)).otherwise(F.least(F.coalesce(F.get(differ, F.lit(0)), n), n)).cast("int")


def common_prefix(a: Column, b: Column) -> Column:
    return F.slice(a, F.lit(1), lcp_length(a, b))


def group_common_prefix(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The prefix that all paths of a group share: that of its smallest and its largest array."""
    bounds = rows.groupBy(*keys).agg(F.min(path).alias("_lo"), F.max(path).alias("_hi"), F.count("*").alias("n"))
    return bounds.select(*keys, "n", common_prefix(F.col("_lo"), F.col("_hi")).alias("prefix"))


def minus(a: Column, b: Column) -> Column:
    """The elements of a that b has nowhere; repeats stay."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def plus(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def hide_repeated(rows: DataFrame, path: str, order: list[str], partition: list[str]) -> DataFrame:
    """Adds ``hidden``: the leading frames that the row before, in order, has too."""
    before = F.lag(path).over(Window.partitionBy(*partition).orderBy(*order))
    return rows.withColumn("hidden", F.coalesce(F.when(before.isNotNull(), lcp_length(F.col(path), before)), F.lit(0)))


def sublist_index(a: Column, b: Column) -> Column:
    """Where b first starts within a, from 0; -1 if nowhere."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a) - F.size(b) + 1, F.lit(1))), lambda i: F.slice(a, i, F.size(b)) == b)
    return F.coalesce(F.get(at, F.lit(0)) - 1, F.lit(-1)).cast("int")


def interleave(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.array(x["a"], x["b"])))


def line_shift(lines: Column) -> Column:
    """Each frame takes the line of the frame that calls it; the root keeps its own."""
    return F.transform(lines, lambda x, i: F.when(i == 0, x).otherwise(F.get(lines, i - 1)))


def cut_at_main(frames: Column, name) -> Column:
    """Frames from the last one named main or MAIN__ on; all of them if there is none."""
    places = F.filter(F.transform(frames, lambda f, i: F.when(name(f).isin("main", "MAIN__"), i + 1)), lambda i: i.isNotNull())
    start = F.coalesce(F.array_max(places), F.lit(1))
    return F.slice(frames, start, F.size(frames))


def frames_of(names: Column, lines: Column, files: Column) -> Column:
    """Frames zipped by place, innermost first as recorded, turned root first and cut at main."""
    zipped = F.transform(F.arrays_zip(names.alias("fn"), lines.alias("line"), files.alias("file")), lambda x: F.struct(x["fn"].alias("fn"), x["line"].cast("int").alias("line"), x["file"].alias("file")))
    return cut_at_main(F.reverse(zipped), lambda f: f["fn"])


#: The calls that all ranks of a communicator take part in.
COLLECTIVES = ("MPI_Barrier", "MPI_Bcast", "MPI_Gather", "MPI_Gatherv", "MPI_Scatter", "MPI_Scatterv", "MPI_Allgather", "MPI_Allgatherv", "MPI_Alltoall", "MPI_Alltoallv", "MPI_Reduce", "MPI_Allreduce", "MPI_Reduce_scatter", "MPI_Scan")


def is_mpi(fn: Column) -> Column:
    return F.contains(fn, F.lit("MPI_"))


def is_collective(fn: Column) -> Column:
    return fn.isin(*COLLECTIVES)


def path_text(frames: Column) -> Column:
    return F.array_join(F.transform(frames, lambda f: F.format_string("%s(%d)", f["fn"], f["line"])), " ")


def same_flow(a: Column, b: Column) -> Column:
    """Whether two paths go through the same functions and lines, on whichever rank and file."""
    key = lambda p: F.transform(p, lambda f: F.struct(f["fn"], f["line"]))
    return key(a) == key(b)


def call_of(frames: Column, fn: str) -> Column:
    """The first frame of a function, or null."""
    return F.get(F.filter(frames, lambda f: f["fn"] == fn), F.lit(0))
