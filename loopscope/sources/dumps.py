"""Smaller text inputs: call-stack dumps, histogram planes, lists of views, solver output."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """(rank, t, frames): lines ``rank#time#lines#calls`` with | between frames, innermost first, turned root first."""
    parts = spark.read.text(path).where("value <> ''").select(F.split("value", "#").alias("f"))
    split = lambda k: F.reverse(F.split(F.col("f")[k], r"\|"))
    frames = F.transform(F.arrays_zip(split(2).alias("l"), split(3).alias("c")), lambda x: F.struct(x["c"].alias("fn"), x["l"].cast("int").alias("line")))
    return parts.select(F.col("f")[0].cast("int").alias("rank"), F.col("f")[1].cast("long").alias("t"), frames.alias("frames"))


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """(plane, row, values): tab-separated planes, each after a line ``---name`` and a header line. The row's cells, name first."""
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).withColumn("one", F.lit(0))
    order = Window.partitionBy("one").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("value").startswith("---"), F.trim(F.substring("value", 4, 1000)))
    held = rows.withColumn("plane", F.last(name, ignorenulls=True).over(order)).where(~F.col("value").startswith("---") & (F.trim("value") != "") & F.col("plane").isNotNull())
    cells = F.split("value", "\t")
    number = F.row_number().over(Window.partitionBy("plane").orderBy("n"))
    return held.withColumn("_r", number).where("_r > 1").select("plane", cells[0].alias("row"), F.transform(cells, lambda x: x.try_cast("double")).alias("values"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines other than blank ones and // comments."""
    return spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("//"))


def solver_array(text: str, name: str) -> list:
    """The array ``name=[...];`` of a solver's output; commas may be blanks. Never evaluated as code."""
    found = re.search(rf"\b{re.escape(name)}\s*=\s*(\[.*?\])\s*;", text, re.S)
    if not found:
        raise KeyError(name)
    return json.loads(re.sub(r"(?<=[\d\].eE])\s+(?=[-\d\[])", ", ", found[1]))
