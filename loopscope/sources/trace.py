"""Traces as text: a header line and colon-separated records, and the dictionary of their events.

Records are read as lines of a splittable text source and decoded by column expressions; one scan
gives states, events and messages. Any first character but 1, 2 and 3 is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Event families by the first six characters of a type, and the bases of loop levels.
FAMILIES = {"420000": "HWC", "500000": "MPI", "501000": "GLOP", "700000": "CALL", "800000": "LINE", "990000": "LOOP", "991000": "ITER", "992000": "NITER"}
LEVEL_BASE = {"LOOP": 99000000, "ITER": 99100000, "NITER": 99200000}
SEND_SIZE, RECV_SIZE, COMMUNICATOR = "50100001", "50100002", "50100004"
#: What an event says, by its family, as a Column of the row (type, value, label); more families and decoders can be added.
DECODERS: dict[str, Callable[[], Column]] = {
    "HWC": lambda: F.lit("counter"),
    "MPI": lambda: F.when(F.col("value") == 0, "exit").otherwise("enter"),
    "GLOP": lambda: F.when(F.col("type") == SEND_SIZE, "send size").when(F.col("type") == RECV_SIZE, "receive size").when(F.col("type") == COMMUNICATOR, "communicator").otherwise("other"),
    "CALL": lambda: F.concat(F.lit("caller "), level_of("CALL")),
    "LINE": lambda: F.concat(F.lit("line "), level_of("LINE")),
    "LOOP": lambda: F.concat(F.when(F.col("value") == 0, "end ").otherwise("begin "), level("LOOP").cast("string")),
    "ITER": lambda: F.concat(F.when(F.col("value") == 0, "end ").otherwise("begin "), level("ITER").cast("string")),
    "NITER": lambda: F.concat(F.lit("iterations "), level("NITER").cast("string")),
}


@dataclass(frozen=True)
class Trace:
    """A trace's tables and header."""

    header: DataFrame
    states: DataFrame
    events: DataFrame
    messages: DataFrame


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): a number that grows along each file; only its order counts."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def _field(k: int, kind: str = "bigint") -> Column:
    return F.get(F.col("f"), F.lit(k)).try_cast(kind)


def _records(rows: DataFrame, first: str) -> DataFrame:
    return rows.where(F.substring("value", 1, 1) == first).withColumn("f", F.split("value", ":"))


def header_of(rows: DataFrame) -> DataFrame:
    """One row (date, total, tasks): of the line that starts with #, the date's text, the run's length and the number of tasks."""
    head = rows.where(F.col("value").startswith("#"))
    fields = head.select(F.regexp_extract("value", r"\(([^)]*)\)", 1).alias("date"), F.split(F.regexp_replace("value", r"^[^(]*\([^)]*\):", ""), ":").alias("f"))
    return fields.select("date", F.regexp_extract(F.col("f")[0], r"^(\d+)", 1).cast("long").alias("total"), F.regexp_extract(F.get("f", F.lit(3)), r"^(\d+)\(", 1).cast("int").alias("tasks"))


def states_of(rows: DataFrame) -> DataFrame:
    return _records(rows, "1").select(_field(3, "int").alias("task"), _field(4, "int").alias("thread"), _field(5).alias("t0"), _field(6).alias("t1"), _field(7, "int").alias("state"))


def events_of(rows: DataFrame) -> DataFrame:
    """(task, thread, t, line_no, pos, type, value, family): the pairs of each event record whose family is known, with their place."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("f") - 6) / 2).cast("int") - 1), lambda k: F.struct(F.get("f", 2 * k + 6).alias("type"), F.get("f", 2 * k + 7).cast("long").alias("value")))
    wide = _records(rows, "2").where(F.size("f") >= 8).select(_field(3, "int").alias("task"), _field(4, "int").alias("thread"), _field(5).alias("t"), "line_no", F.posexplode(pairs).alias("pos", "e"))
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[F.substring("e.type", 1, 6)]
    return wide.select("task", "thread", "t", "line_no", "pos", "e.type", "e.value", family.alias("family")).where(F.col("family").isNotNull())


def messages_of(rows: DataFrame) -> DataFrame:
    names = [("send_task", 3), ("send_thread", 4), ("t_send", 5), ("p_send", 6), ("recv_task", 9), ("recv_thread", 10), ("t_recv", 11), ("p_recv", 12), ("size", 13), ("tag", 14)]
    return _records(rows, "3").select(*[_field(k).alias(n) for n, k in names])


def read_trace(spark: SparkSession, path: str) -> Trace:
    rows = lines(spark, path)
    return Trace(header_of(rows), states_of(rows), events_of(rows), messages_of(rows))


def task_ids(trace: Trace) -> DataFrame:
    """The tasks that the (maybe partial) trace holds."""
    return trace.events.select("task").union(trace.states.select("task")).distinct()


def level(family: str) -> Column:
    """The nesting level of a loop mark."""
    return F.col("type").cast("long") - LEVEL_BASE[family]


def level_of(family: str) -> Column:
    """The depth of a caller or of its line: what its type adds to the family's first."""
    base = next(k for k, v in FAMILIES.items() if v == family)
    return (F.col("type").cast("long") - int(base + "00")).cast("string")


def decoded(events: DataFrame) -> DataFrame:
    """``events`` with ``meaning``, by the decoder of each event's family."""
    arms = F.coalesce(*[F.when(F.col("family") == family, make()) for family, make in DECODERS.items()])
    return events.withColumn("meaning", arms)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(event_type, type_name, value, label) of a dictionary file, which is small and read as one row; see ``dictionary_of``."""
    return dictionary_of(spark.read.text(path, wholetext=True))


def dictionary_of(files: DataFrame) -> DataFrame:
    """(event_type, type_name, value, label) of a dictionary's whole text (value).

    A line EVENT_TYPE starts a block whose lines are ``group type name``; VALUES starts its values,
    lines of ``value label``. A blank line ends a block, a line GRADIENT_ takes the block out.
    """
    rows = files.select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "x")).withColumn("file", F.lit(0))
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("x") == "EVENT_TYPE", "type").when(F.col("x") == "VALUES", "values").when(F.trim("x") == "", "none").when(F.col("x").startswith("GRADIENT_"), "none")
    block = F.sum((F.col("x") == "EVENT_TYPE").cast("int")).over(order)
    kind = rows.withColumn("block", block).withColumn("_m", mark).withColumn("kind", F.last("_m", ignorenulls=True).over(order)).where(F.col("_m").isNull())
    types = kind.where("kind = 'type'").select("block", F.regexp_extract("x", r"^\s*\S+\s+(\d+)\s+(.*)$", 1).alias("event_type"), F.regexp_extract("x", r"^\s*\S+\s+(\d+)\s+(.*)$", 2).alias("type_name"))
    values = kind.where("kind = 'values'").select("block", F.regexp_extract("x", r"^\s*(\d+)\s+(.*)$", 1).alias("value"), F.regexp_extract("x", r"^\s*(\d+)\s+(.*)$", 2).alias("label"))
    return types.join(values, "block", "left").drop("block")


def matching(dictionary: DataFrame, text: str) -> DataFrame:
    """The values of types whose name holds ``text``."""
    return dictionary.where(F.contains("type_name", F.lit(text)))


def translate(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``events`` with label: the dictionary's, or type_value where it has none."""
    names = dictionary.select(F.col("event_type").alias("_t"), F.col("value").cast("string").alias("_v"), F.col("label").alias("_l"))
    found = events.join(names, (F.col("event_type") == F.col("_t")) & (F.col("value").cast("string") == F.col("_v")), "left")
    return found.select(*events.columns, F.coalesce("_l", F.concat_ws("_", "event_type", F.col("value").cast("string"))).alias("label"))


def call_name(label: Column) -> Column:
    """A frame's function: the text in brackets if there is any; template arguments are cut."""
    inner = F.regexp_extract(label, r"\[([^\]]*)\]", 1)
    return F.regexp_replace(F.when(inner != "", inner).otherwise(label), "<.*$", "")


def line_parts(label: Column) -> Column:
    """``line (file, image)`` as a struct; without a file only the line."""
    part = lambda k: F.nullif(F.trim(F.regexp_extract(label, r"^\s*(\d+)\s*(?:\(\s*([^,)]*)\s*(?:,\s*([^)]*))?\))?", k)), F.lit(""))
    return F.struct(part(1).cast("int").alias("line"), part(2).alias("file"), part(3).alias("image"))


def counter_name(type_name: Column) -> Column:
    """A counter's short name: the first word."""
    return F.regexp_extract(type_name, r"^\s*(\S+)", 1)


def split_kinds(rows: DataFrame) -> DataFrame:
    """``rows`` with kind (info, comm, task) and task: the part of a split trace that each line goes to. Communicator lines go nowhere."""
    kind = F.when(F.col("value").startswith("#"), "info").when(F.col("value").startswith("3:"), "comm").when(F.col("value").rlike("^[12]:"), "task")
    return rows.withColumn("kind", kind).where(F.col("kind").isNotNull()).withColumn("task", F.get(F.split("value", ":"), F.lit(3)).try_cast("int"))


def write_split(rows: DataFrame, path: str) -> None:
    """The lines of a trace in one folder per kind and task, so that one task is read alone."""
    split_kinds(rows).select("value", "kind", "task").write.partitionBy("kind", "task").mode("overwrite").text(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A split trace's lines with their kind and task; filters on these prune folders."""
    return spark.read.schema("value string, kind string, task int").text(path).withColumn("line_no", F.monotonically_increasing_id())
