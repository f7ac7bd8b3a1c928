"""Nearest neighbours by inner product: NN-descent builds a graph, queries search it greedily.

Equal vectors are one node, that their smallest id stands for, so that a vector which many rows
share weighs no more than any other. Nodes are dealt to cells by the nearest direction of some drawn
ones, and large cells by hash to shards of bounded size. In each round every node gathers its
neighbours and some of the nodes that have it for one (a join with their vectors), compares these
with each other, and hands each the best of the others: neighbours of neighbours, that a second join
merges into the lists kept. The graph is by direction, each vector at its own scale, so that lengths
of any spread do no harm.

A query goes to the shards of the nearest cells. There it starts from its own node and the nearest of
some nodes drawn and of the longest, and takes the neighbours of the best nodes not yet expanded,
until none of the best ``BEAM`` is left. The longest vectors of all, which can be near to any query
however they point, are compared to every query. The nodes found are scored in double precision on
the vectors as given. What is sent follows the rows: a query goes to a fixed number of cells, and a
shard is copied once for each ``QUERIES`` queries that come to it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopscope.llm.tables import Stored

#: Neighbours of a node, nodes gathered that have it for one, those handed on, and rounds.
NEIGHBOURS, REVERSE, HANDED, ROUNDS = 24, 12, 8, 6
#: Nodes of a shard, spread over it, that a query is compared to for its entries: all parts of a graph that
#: falls apart by clusters have some of them, unless they are smaller than a node's list. As many of its longest.
COARSE = 2_048
#: The longest vectors of all that every query is compared to; cells that a query goes to; cells at most.
LONGEST, VISITED, CELLS = 2_048, 8, 65_536
#: Nodes of a shard and queries searched in one task, at most on average.
SHARD, QUERIES = 16_384, 4_096
#: Nodes that a search keeps, expands at once and starts from.
BEAM, EXPANDED, ENTRIES = 320, 8, 48
#: Parts that the rows of one vector are dealt to.
PARTS = 64

_FOUND = np.dtype([("node", "<i8"), ("near", "<f4")])


def _least(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The rows with the n smallest ids of each key, first within parts of it."""
    part = Window.partitionBy(*keys, "part").orderBy("id")
    inner = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= n)
    return inner.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= n).drop("r", "part")


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, e, k1, k2): rows with an id and a vector without nulls or non-finite components, not zero, of the most frequent length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("e").isNotNull()).where(finite & F.exists("e", lambda x: x != 0))
    size = rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = rows.where(F.size("e") == (size["d"] if size else 0))
    return rows.select("id", "e", F.xxhash64("e").alias("k1"), F.xxhash64(F.reverse("e")).alias("k2"))


def _packed(e: pa.Array) -> np.ndarray:
    return e.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(e), -1)


def _directions(x: np.ndarray) -> np.ndarray:
    """Vectors of any length at length one, in single precision."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _codes(nodes: DataFrame) -> DataFrame:
    """(node, code): the vectors for the graph, each at its own scale, a byte a component."""

    def make(batches):
        for batch in batches:
            if batch.num_rows:
                x = _packed(batch.column(1))
                codes = np.rint(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["node", "code"])

    return nodes.select("node", "e").mapInArrow(make, "node long, code binary")


def _nearest_cells(rows: DataFrame, cells: np.ndarray, count: int) -> DataFrame:
    """``rows`` (rep, e) once for each of the ``count`` nearest cells, as (rep, e, cell)."""
    held = rows.sparkSession.sparkContext.broadcast(cells)

    def make(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                near, n = _directions(_packed(batch.column(1))) @ held.value.T, min(count, len(held.value))
                best = np.argpartition(-near, n - 1, axis=1)[:, :n]
                row = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(best.ravel().astype(np.int64))], ["rep", "e", "cell"])

    return rows.select("rep", "e").mapInArrow(make, "rep long, e array<double>, cell long")


def _best_of(reps: np.ndarray, vectors: np.ndarray, rough: np.ndarray, query: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` best of some nodes and their exact scores, chosen by rough ones first."""
    few = np.argsort(-rough, kind="stable")[: 2 * wanted]
    score = np.array([math.sumprod(vectors[i], query) for i in few])
    order = np.lexsort((reps[few], -score))[:wanted]
    return reps[few[order]], score[order]


def _among_longest(queries: DataFrame, reps: np.ndarray, vectors: np.ndarray, wanted: int) -> DataFrame:
    """(query, node, score): the best of the longest vectors for each query."""
    held = queries.sparkSession.sparkContext.broadcast((reps, vectors))

    def make(batches):
        ids, x = held.value
        scale = np.abs(x).max() if len(x) else 1.0
        for whole in batches:
            for at in range(0, whole.num_rows if len(ids) else 0, 500):
                batch = whole.slice(at, 500)
                asked = _packed(batch.column(1))
                rough = (asked / np.abs(asked).max(1, keepdims=True)) @ (x / scale).T
                found = [_best_of(ids, x, r, q, wanted) for r, q in zip(rough, asked, strict=True)]
                names = np.repeat(batch.column(0).to_numpy(), [len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query", "node", "score"])

    return queries.select("rep", "e").mapInArrow(make, "query long, node long, score double")


def _handed(batches):
    """From each node's gathered (node, code) list, to each of these the nearest of the others."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch, to, found = whole.slice(at, 500), [np.zeros(0, np.int64)], []
            for row_nodes, row_codes in zip(batch.column(0), batch.column(1), strict=True):
                nodes = row_nodes.values.to_numpy()
                if len(nodes) < 2:
                    continue
                x = np.frombuffer(b"".join(row_codes.values.to_pylist()), np.int8).reshape(len(nodes), -1).astype(np.float32)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                near, n = x @ x.T, min(HANDED, len(nodes) - 1)
                np.fill_diagonal(near, -np.inf)
                best = np.argpartition(-near, n - 1, axis=1)[:, :n]
                out = np.empty(best.shape, _FOUND)
                out["node"], out["near"] = nodes[best], np.take_along_axis(near, best, 1)
                to.append(nodes)
                found += [o.tobytes() for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), pa.array(found, pa.binary())], ["node", "found"])


def _merged(batches):
    """Of the lists handed to each node the best neighbours, each once."""
    for whole in batches:
        nodes, lists = [], []
        for node, found in zip(whole.column(0).to_pylist(), whole.column(1), strict=True):
            all_ = np.frombuffer(b"".join(found.values.to_pylist()), _FOUND)
            all_ = all_[np.unique(all_["node"], return_index=True)[1]]
            all_ = all_[all_["node"] != node]
            lists.append(all_[np.argsort(-all_["near"], kind="stable")[:NEIGHBOURS]].tobytes())
            nodes.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(lists, pa.binary())], ["node", "found"])


def _exploded(batches):
    """(node, other) of every list."""
    for whole in batches:
        found = [np.frombuffer(x.as_py(), _FOUND)["node"] for x in whole.column(1)]
        nodes = np.repeat(whole.column(0).to_numpy(), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["node", "other"])


def build_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, found): the neighbour lists of ``nodes`` (node, shard, place, size, e), by NN-descent within shards."""
    codes = Stored(_codes(nodes), "codes").df
    # The first neighbours are drawn by hash; a node's number is its shard's first number and its place.
    drawn = F.transform(F.sequence(F.lit(1), F.lit(NEIGHBOURS)), lambda k: F.col("node") - F.col("place") + F.pmod(F.xxhash64("node", k), F.col("size")))
    pairs = nodes.select("node", F.explode(F.array_distinct(drawn)).alias("other")).where("node <> other")
    kept = None
    for k in range(rounds):
        some = Window.partitionBy("node").orderBy(F.xxhash64("node", "other", F.lit(k)), "other")
        back = pairs.select(F.col("other").alias("node"), F.col("node").alias("other")).withColumn("r", F.row_number().over(some)).where(F.col("r") <= REVERSE).drop("r")
        around = pairs.union(back).distinct()
        gathered = around.join(codes.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.collect_list(F.struct("other", "code")).alias("l"))
        handed = gathered.select(F.col("l.other").alias("nodes"), F.col("l.code").alias("codes")).mapInArrow(_handed, "node long, found binary")
        lists = handed if kept is None else handed.unionByName(kept.df)
        new = Stored(lists.groupBy("node").agg(F.collect_list("found").alias("found")).mapInArrow(_merged, "node long, found binary"), "graph")
        if kept is not None:
            kept.drop()
        kept = new
        pairs = kept.df.mapInArrow(_exploded, "node long, other long")
    return kept.df


def _adjacency(place: np.ndarray, first: int, found: list[bytes | None]) -> np.ndarray:
    """Places of each node's neighbours and of as many that have it for one, -1 where there are fewer."""
    n = len(place)
    lists = [np.frombuffer(x or b"", _FOUND)["node"] - first for x in found]
    src = np.repeat(place, [len(x) for x in lists])
    dst = np.concatenate([np.zeros(0, np.int64), *lists])
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    # A node's own neighbours come before those that have it for one.
    own = np.concatenate([np.zeros(len(src), np.int64), np.ones(len(src), np.int64)])
    keep = np.unique(a * n + b, return_index=True)[1]
    a, b, own = a[keep], b[keep], own[keep]
    order = np.lexsort((own, a))
    a, b = a[order], b[order]
    column = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, 2 * NEIGHBOURS), -1)
    few = column < 2 * NEIGHBOURS
    out[a[few], column[few]] = b[few]
    return out


def greedy_search(adjacency: np.ndarray, vectors: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The places of the best nodes that greedy search finds for each query, -1 where there are fewer."""
    n, size = len(queries), len(vectors)
    seen = np.zeros((n, size), bool)
    best, near, done = np.full((n, beam), -1), np.full((n, beam), -np.inf, np.float32), np.ones((n, beam), bool)
    rows = np.arange(n)[:, None]
    todo = start
    while True:
        q, c = np.repeat(np.arange(n), todo.shape[1]), todo.ravel()
        q, c = q[c >= 0], c[c >= 0]
        fresh = np.unique(q * size + c)
        q, c = fresh // size, fresh % size
        new = ~seen[q, c]
        q, c = q[new], c[new]
        if not len(q):
            if not (~done).any():
                return best
        else:
            seen[q, c] = True
            value = np.einsum("ij,ij->i", vectors[c], queries[q])
            column = np.arange(len(q)) - np.searchsorted(q, q)
            width = int(column.max()) + 1
            more, far = np.full((n, width), -1), np.full((n, width), -np.inf, np.float32)
            more[q, column], far[q, column] = c, value
            best, near, done = np.concatenate([best, more], 1), np.concatenate([near, far], 1), np.concatenate([done, more < 0], 1)
            order = np.argsort(-near, axis=1, kind="stable")[:, :beam]
            best, near, done = best[rows, order], near[rows, order], done[rows, order]
        if not (~done).any():
            return best
        pick = np.argsort(done, axis=1, kind="stable")[:, :EXPANDED]
        open_ = ~done[rows, pick]
        done[rows, pick] = True
        todo = np.where(open_[:, :, None], adjacency[np.maximum(best[rows, pick], 0)], -1).reshape(n, -1)


def _entries(coarse: np.ndarray, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each query the ENTRIES nearest of the coarse nodes."""
    near, n = queries @ vectors[coarse].T, min(ENTRIES, len(coarse))
    return coarse[np.argpartition(-near, n - 1, axis=1)[:, :n]]


def _searcher(wanted: int):
    def search(key, nodes: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "node", "score"]
        if not nodes.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        nodes = nodes.sort_by("place").combine_chunks()
        exact, reps = _packed(nodes.column("e").combine_chunks()), nodes.column("rep").to_numpy()
        place = nodes.column("place").to_numpy()
        adjacency = _adjacency(place, int(nodes.column("node")[0].as_py()), nodes.column("found").to_pylist())
        asked, names_q = _packed(queries.column("e").combine_chunks()), queries.column("rep").to_numpy()
        # At the scale of the largest component, numbers of any size are within single precision.
        vectors = (exact / np.abs(exact).max()).astype(np.float32)
        scaled = (asked / np.abs(asked).max(1, keepdims=True)).astype(np.float32)
        # Places go by id, which can go by cluster, so that the coarse nodes are drawn.
        drawn = np.random.default_rng(len(place)).permutation(len(place))[:COARSE]
        longest = np.argsort(-(vectors * vectors).sum(1), kind="stable")[:COARSE]
        coarse = np.unique(np.concatenate([drawn, longest]))
        at = np.searchsorted(reps, names_q, sorter=(by := np.argsort(reps)))
        own = by[np.minimum(at, len(reps) - 1)]
        own = np.where(reps[own] == names_q, own, -1)
        out = []
        for a in range(0, len(asked), 256):
            some = scaled[a : a + 256]
            start = np.column_stack([_entries(coarse, vectors, some), own[a : a + 256]])
            found = greedy_search(adjacency, vectors, some, start)
            for k in range(len(some)):
                c = found[k][found[k] >= 0]
                nodes_found, score = _best_of(reps[c], exact[c], vectors[c] @ some[k], asked[a + k], wanted)
                out.append((np.full(len(score), names_q[a + k]), nodes_found, score))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names)

    return search


def _length(e: str) -> Column:
    """A vector's length; its largest component is taken out first, so that no square overflows."""
    most = F.array_max(F.transform(e, F.abs))
    return most * F.sqrt(F.aggregate(F.transform(e, lambda x: x / most), F.lit(0.0), lambda s, x: s + x * x))


def _drawn_cells(classes: DataFrame, count: int) -> np.ndarray:
    """Directions of ``count`` nodes at most, those of the smallest hashes; one a shard, so that no more than CELLS come to the driver."""
    if count < 2:
        return np.zeros((1, 0), np.float32)
    rows = classes.select("e", F.xxhash64("rep", F.lit(2)).alias("draw")).orderBy("draw").limit(count).collect()
    return _directions(np.array([r["e"] for r in rows], np.float64))


def nearest(vectors: DataFrame, query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, rounds: int = ROUNDS, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``query`` holds for (over its id, named ``id``).

    Every row but the query's own is a candidate; nearer is the larger inner product, in double
    precision, then the smaller id. Vectors that are null, zero, or hold null or non-finite
    components take no part, nor do rows without an id or of other than the most frequent
    length, since such have no inner product with the others. Rows that repeat an id and a vector
    count once. With at most k candidates all are returned; an empty table gives an empty one.
    """
    usable = Stored(_usable(vectors, id_col, vector_col), "vectors").df
    classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("n"), F.first("e").alias("e"))
    classes = Stored(classes, "classes").df
    n = classes.count()
    n_cells = min(CELLS, max(1, math.ceil(n / shard)))
    cells = _drawn_cells(classes, n_cells)
    dealt = _nearest_cells(classes, cells, 1) if n_cells > 1 else classes.select("rep", "e", F.lit(0).cast("long").alias("cell"))
    dealt = Stored(dealt, "dealt").df
    # Cells of more nodes than a shard holds are dealt on by hash; shards are numbered along the cells.
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(shard)).cast("long").alias("shards"))
    shards = Stored(sizes.withColumn("first", F.sum("shards").over(Window.orderBy("cell")) - F.col("shards")), "cells").df
    numbered = dealt.join(shards, "cell").select("rep", "e", (F.col("first") + F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shards"))).alias("shard"))
    along = Window.partitionBy("shard")
    nodes = numbered.withColumn("place", F.row_number().over(along.orderBy("rep")).cast("long") - 1).withColumn("size", F.count("*").over(along))
    nodes = Stored(nodes.withColumn("node", F.col("shard") * F.lit(1 << 32) + F.col("place")), "nodes").df
    graph = build_graph(nodes, rounds)

    asked = Stored(usable.where(query).select("id", "k1", "k2").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("id").alias("query_id"), "rep"), "asked").df
    from_classes = Stored(asked.select("rep").distinct().join(classes.select("rep", "e"), "rep"), "queries").df
    routed = _nearest_cells(from_classes, cells, VISITED) if n_cells > 1 else from_classes.select("rep", "e", F.lit(0).cast("long").alias("cell"))
    routed = routed.join(shards, "cell").select("rep", "e", F.explode(F.expr("sequence(first, first + shards - 1)")).alias("shard"))
    routed = Stored(routed, "routed").df
    parts = Stored(routed.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("long").alias("parts")), "parts").df
    held = nodes.join(graph, "node", "left").join(parts, "shard").select("shard", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "node", "place", "rep", "e", "found")
    sent = routed.join(parts, "shard").select("shard", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), "rep", "e")
    found = held.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInArrow(_searcher(k + 1), "query long, node long, score double")
    top = classes.select("rep", "e", _length("e").alias("len")).orderBy(F.desc("len"), "rep").limit(LONGEST).collect()
    longest = np.array([r["e"] for r in top], np.float64).reshape(len(top), -1 if top else 0)
    found = found.unionByName(_among_longest(from_classes, np.array([r["rep"] for r in top], np.int64), longest, k + 1)).groupBy("query", "node").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = Stored(found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"), "found").df

    # Nodes that stand for several rows give the smallest ids of these.
    several = usable.join(classes.where("n > 1").select("k1", "k2", "rep"), ["k1", "k2"]).select("rep", "id").distinct()
    members = _least(several, ["rep"], k + 1).groupBy("rep").agg(F.collect_list("id").alias("ids"))
    rows = found.join(Stored(members, "members").df, F.col("node") == F.col("rep"), "left").select("query", "score", F.explode(F.coalesce("ids", F.array("node"))).alias("id"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    lists = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("l"))
    lists = Stored(lists, "lists").df
    answer = asked.join(lists, F.col("rep") == F.col("query")).select("query_id", F.posexplode(F.slice(F.filter("l", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("rank", "x"))
    return answer.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
