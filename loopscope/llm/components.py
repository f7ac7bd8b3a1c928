"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopscope.llm.tables import Stored


def connected(edges: DataFrame) -> DataFrame:
    """The columns ``node`` and ``root``, the smallest node reachable, of every node of ``edges`` (a, b).

    Each round a node takes the least label around it, hands that on to the node whose label it
    bore, and then takes its label's label, so that the rounds needed grow with the logarithm of
    the longest path. Labels are written to the shared folder between rounds; nothing but one sum
    comes to the driver. A label shared by many nodes meets only aggregates that combine before
    the shuffle, and a join of two stored tables whose partitions can be split.

    Null ends and loops are ignored; an empty table gives an empty one.
    """
    both = Stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).toDF("u", "v").distinct(), "edges")
    labels = Stored(both.df.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    known = None
    while True:
        around = both.df.join(labels.df, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("least"))
        own = around.join(labels.df, F.col("u") == F.col("node")).select("node", "label", F.least("label", "least").alias("least"))
        hooked = own.select(F.explode(F.array("node", "label")).alias("node"), "least").groupBy("node").agg(F.min("least").alias("label"))
        step = Stored(hooked, "hooked")
        left, right = step.df.select("node", F.col("label").alias("via")), step.df.select(F.col("node").alias("via_node"), F.col("label"))
        new = Stored(left.join(right, F.col("via") == F.col("via_node")).select("node", "label"), "labels")
        labels.drop()
        step.drop()
        labels = new
        # Labels only ever fall, so an equal sum means equal labels.
        now = labels.df.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == known:
            both.drop()
            return labels.df.select("node", F.col("label").alias("root"))
        known = now
