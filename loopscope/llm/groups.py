"""Links between items that share keys, whatever the number of items a key has.

Items of a key that few share are paired. A key of more items is not paired out at once: its items
are compared to a pivot, that of them which has the most such keys, since this is in the middle of
its like. Those linked to it are connected and are compared no more among each other; the others go
to the next pivot. What is left after some rounds is paired out. Items that no chain of links joins
to a pivot of theirs are then compared to those linked to it that they may be linked to. So no two items that share a key and are linked are
left without a path, and a group of copies costs about as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopscope.llm.components import connected
from loopscope.llm.tables import Stored

#: Items of one key that are paired; keys with more go by pivots, in so many rounds at most.
PAIRED, ROUNDS = 4, 4

#: What two items need to be linked, of their columns by name; a row that can't be told yet may be.
Possible = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def pairs_within(keyed: DataFrame, info: list[str], possible: Possible) -> DataFrame:
    """(a, b), each once: the possible pairs of items within each key, of (key, c, *info)."""
    lists = keyed.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("c", *info))).alias("m")).where(F.size("m") > 1)
    pairs = lists.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    fits = pairs.where(possible(lambda n: F.col(f"x.{n}"), lambda n: F.col(f"y.{n}")))
    return fits.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()


def links_by_pivots(left: DataFrame, info: list[str], verified: Callable[[DataFrame, bool], DataFrame], possible: Possible, reach: Possible) -> tuple[DataFrame, DataFrame] | None:
    """Edges (a, b) that connect what linked items within each key of ``left`` (key, c, *info) connect; None if there is nothing to compare.

    With them come (node, root) of items that edges are known to connect, for whom this saves comparisons.

    ``verified`` gives pairs (a, b) with linked and, if its second argument is true, j, how similar they are.
    ``reach`` tells whether an item not linked to the pivot may be linked to one that is, of their columns and their j.
    """
    found, paired, apart = [], [], []
    # Of as many keys the smaller hash goes first, so that the keys of one group of copies have few different pivots.
    order = (F.count("*") * F.lit(-(1 << 40)) + F.pmod(F.xxhash64("c"), F.lit(1 << 40))).alias("o")
    left = Stored(left.join(left.groupBy("c").agg(order), "c"), "left").df.select("key", "c", "o", *info)
    for _ in range(ROUNDS):
        pivots = left.groupBy("key").agg(F.min_by("c", "o").alias("p"), F.min("o").alias("po"), F.count("*").alias("k")).where("k > 1").select("key", "p", "po")
        around = Stored(left.join(pivots, "key").where(F.col("c") != F.col("p")), "around").df
        if around.isEmpty():
            left = None
            break
        fits = Stored(verified(around.select(F.col("p").alias("a"), F.col("c").alias("b")).distinct(), True), "fits").df
        marked = Stored(around.join(fits.select(F.col("a").alias("p"), F.col("b").alias("c"), "j", "linked"), ["p", "c"]), "marked").df
        found.append(marked.where("linked").select("c", "p", "po"))
        apart.append(marked)
        left = marked.where(~F.col("linked")).select("key", "c", "o", *info)
    if left is not None:
        paired.append(verified(pairs_within(left, info, possible), False).where("linked").select("a", "b"))
    if not found:
        return None
    joined = Stored(_union([by_first_pivots(_union(found)), *paired]), "links").df
    roots = Stored(connected(joined), "roots").df
    found = [roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))]
    # The rounds' items go together, so that what is left to compare is compared once.
    marked = _union([x.withColumn("round", F.lit(k)) for k, x in enumerate(apart)])
    near = marked.where(~F.col("linked")).join(roots.toDF("c", "root"), "c", "left").join(roots.toDF("p", "root_p"), "p").where(F.coalesce("root", "c") != F.col("root_p"))
    near = near.select("key", "round", *[F.col(x).alias(f"{x}_a") for x in ("c", "j", *info)])
    linked = marked.where("linked").select("key", "round", *[F.col(x).alias(f"{x}_b") for x in ("c", "j", *info)])
    reached = near.join(linked, ["key", "round"]).where(reach(lambda n: F.col(f"{n}_a"), lambda n: F.col(f"{n}_b")))
    found.append(verified(reached.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), False).where("linked").select("a", "b"))
    return Stored(_union(found), "links").df, roots


def by_first_pivots(linked: DataFrame) -> DataFrame:
    """Edges (a, b), each once, that connect what the links of ``linked`` (c, p, po) connect: of each item to its first pivot by po, and of that to its others.

    Pivots are few, so that a group has about as many edges as members, whatever the number of keys that these share.
    """
    lists = linked.groupBy("c").agg(F.sort_array(F.collect_set(F.struct("po", "p"))).alias("ps"))
    edges = F.expr("transform(ps, (x, i) -> struct(ps[0].p as a, if(i = 0, c, x.p) as b))")
    return lists.select(F.explode(edges).alias("e")).select("e.a", "e.b").distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
