"""Trace texts, operators on small cases, whole programs, streams."""

import io
import math
import random

import pytest
from pyspark.sql import functions as F

from loopscope.functions import paths, scalars
from loopscope.operators import alias, callstacks, clustering, flow, loopstats, nesting, occurrences, phases, ranks, reduction
from loopscope.plans import render, shell
from loopscope.plans.inference import infer
from loopscope.sources import dumps, trace
from loopscope.streaming import online
from tests import tracegen


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


@pytest.fixture(scope="module")
def text(tmp_path_factory):
    folder = tmp_path_factory.mktemp("trace")
    (folder / "a.prv").write_text(tracegen.TRACE)
    (folder / "a.pcf").write_text(tracegen.DICTIONARY)
    return folder


def test_records(spark, text):
    t = trace.read_trace(spark, str(text / "a.prv"))
    assert rows(t.header) == [("01/02/2020 at 10:11", 5000, 2)]
    assert rows(t.states) == [(1, 1, 0, 500, 1)]
    assert rows(t.messages) == [(1, 1, 1000, 1001, 2, 1, 1700, 1701, 64, 7)]
    assert rows(t.events, "task", "t", "pos", "type", "value", "family")[:2] == [(1, 1000, 0, "50000001", 2, "MPI"), (1, 1000, 1, "70000001", 1, "CALL")]
    assert t.events.where("type = '12345678'").count() == 0
    assert rows(trace.task_ids(t)) == [(1,), (2,)]
    assert rows(t.events.where("family = 'LOOP'").select(trace.level("LOOP"), F.col("value") == 0)) == [(1, False), (1, True)]


def test_dictionary(spark, text):
    d = trace.read_dictionary(spark, str(text / "a.pcf"))
    assert rows(d.where("event_type = '50000001'"), "type_name", "value", "label") == [("MPI Point-to-point", "0", "End"), ("MPI Point-to-point", "2", "MPI_Send"), ("MPI Point-to-point", "3", "MPI_Recv")]
    assert d.where("event_type like '7000000%'").count() == 4
    assert rows(d.where("event_type = '42000050'").select(trace.counter_name(F.col("type_name")), "value")) == [("PAPI_TOT_INS", None)]
    assert trace.matching(d, "Caller").count() == 4
    events = spark.createDataFrame([("50000001", 3), ("50000001", 99)], "event_type string, value long")
    assert rows(trace.translate(events, d), "label") == [("50000001_99",), ("MPI_Recv",)]
    labels = spark.createDataFrame([("work [real_work]",), ("f<int>",), ("g",)], "l string")
    assert rows(labels.select(trace.call_name(F.col("l")))) == [("f",), ("g",), ("real_work",)]
    places = spark.createDataFrame([("12 (a.c, exe)",), ("7",), ("9 (b.c)",)], "l string")
    assert rows(places.select(trace.line_parts(F.col("l")).alias("p")).select("p.*")) == [(12, "a.c", "exe"), (7, None, None), (9, "b.c", None)]


def test_split_traces(spark, text, tmp_path):
    trace.write_split(trace.lines(spark, str(text / "a.prv")), str(tmp_path / "s"))
    back = trace.read_split(spark, str(tmp_path / "s"))
    assert rows(back.groupBy("kind").count()) == [("comm", 1), ("info", 1), ("task", 7)]
    assert trace.events_of(back.where("kind = 'task' and task = 2")).count() == 2


def test_dumps(spark, tmp_path):
    (tmp_path / "stacks").write_text("0#10#5|20#f|main\n1#12#6|20#g|main\n")
    found = dumps.read_stacks(spark, str(tmp_path / "stacks"))
    assert rows(found.select("rank", "t", F.transform("frames", lambda f: f["fn"]).alias("f"))) == [(0, 10, ["main", "f"]), (1, 12, ["main", "g"])]
    (tmp_path / "planes").write_text("---loop 1\n\tA\tB\t\nTotal\t1\t2\t\nAverage\t3\t5\t\n---loop 2\n\tA\tB\t\nTotal\t4\t6\t\n")
    cells = dumps.read_planes(spark, str(tmp_path / "planes"))
    assert rows(loopstats.plane_statistics(cells, "plane", "row", "values", ("Total", "Average"))) == [("loop 1", 1.5, 4.0), ("loop 2", 5.0, None)]
    (tmp_path / "list").write_text("// views\n\na.cfg\n b.cfg\n")
    assert dumps.read_list(spark, str(tmp_path / "list")).count() == 2
    assert dumps.solver_array("x=[1 2 3];\nused = [[0 1]\n [1 0]];", "used") == [[0, 1], [1, 0]]
    with pytest.raises(KeyError):
        dumps.solver_array("x=[1];", "y")


def test_path_functions(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "d"]), ([], ["a"]), (["a"], ["a", "a"]), (["x", "a", "a"], ["a"])], "a array<string>, b array<string>")
    found = df.select(paths.common_prefix(F.col("a"), F.col("b")), paths.minus(F.col("a"), F.col("b")), paths.sublist_index(F.col("a"), F.col("b")), paths.plus(F.col("a"), F.col("b")))
    assert [tuple(r) for r in found.collect()] == [(["a", "b"], ["c"], -1, ["a", "b", "c", "a", "b", "d"]), ([], [], -1, ["a"]), (["a"], [], -1, ["a", "a", "a"]), ([], ["x"], 1, ["x", "a", "a", "a"])]
    frames = spark.createDataFrame([(["w", "main", "start"], [3, 9, 1], ["f", "f", "f"])], "n array<string>, l array<int>, f array<string>").select(paths.frames_of(F.col("n"), F.col("l"), F.col("f")).alias("p"))
    assert rows(frames.select(paths.path_text(F.col("p")), paths.call_of(F.col("p"), "w")["line"])) == [("main(9) w(3)", 3)]
    assert rows(spark.createDataFrame([("MPI_Scan",), ("MPI_Send",), ("f",)], "fn string").select("fn", paths.is_mpi(F.col("fn")), paths.is_collective(F.col("fn")))) == [("MPI_Scan", True, True), ("MPI_Send", True, False), ("f", False, False)]
    lines = spark.createDataFrame([([1, 2, 3],)], "l array<int>").select(paths.line_shift(F.col("l")), paths.interleave(F.col("l"), F.reverse("l")))
    assert [tuple(r) for r in lines.collect()] == [([1, 1, 2], [1, 3, 2, 2, 3, 1])]


def test_scalars(spark):
    df = spark.createDataFrame([(999.0,), (1000.0,), (1024.0,), (1025.0,), (0.0,), (2.5e9,)], "x double")
    found = {r[0]: tuple(r)[1:] for r in df.select("x", scalars.scale_time(F.col("x")), scalars.scale_bytes(F.col("x")), scalars.scale_bytes(F.col("x"), True)).collect()}
    assert found[999.0] == ("999.0ns", "999.0B", "999.0B") and found[1000.0][0] == "1.0us" and found[1000.0][2] == "1.0KB"
    assert found[1024.0][1] == "1024.0B" and found[1025.0][1] == "1.0KB" and found[0.0][1:] == ("-", "-") and found[2.5e9][0] == "2.5s"
    h = 5381
    for c in b"a.c_12":
        h = (h * 33 + c) & 0xFFFFFFFF
    assert spark.range(1).select(scalars.uid(F.lit("a.c_12"))).first()[0] == h
    assert spark.range(1).select(scalars.reconstructed(F.lit(40), 0.2, F.lit(1))).first()[0] == pytest.approx(1000)
    pairs = spark.sql("select array(named_struct('rank', 0, 'partners', array(1, -1, 3)), named_struct('rank', 2, 'partners', array(0))) p, array(0) s")
    assert pairs.select(scalars.partners_text(F.col("p"), F.col("s"))).first()[0] == "0:1,3"


# Alias split


def matrix(spark, instants):
    df = spark.createDataFrame([(0, p, t) for p, ts in instants.items() for t in ts], "m int, path string, t long")
    return alias.wrap_columns(df, ["m"], "path", "t")


def test_alias_fixtures(spark):
    two = matrix(spark, {"A": [1, 3], "B": [2, 4], "C": [5, 7], "D": [6, 8]})
    assert rows(alias.aliased(two, ["m"])) == [(0, True)]
    blocks = alias.dense_blocks(alias.dense_runs(two, ["m"]), ["m"])
    assert rows(alias.subloops(blocks, ["m"]), "r0", "r1", "n_blocks") == [(1, 2, 1), (3, 4, 1)]
    assert rows(alias.superloops(blocks, ["m"]), "hidden") == [(False,)]
    four = matrix(spark, {"A": [1, 3, 9, 11], "B": [2, 4, 10, 12], "C": [5, 7, 13, 15], "D": [6, 8, 14, 16]})
    blocks = alias.dense_blocks(alias.dense_runs(four, ["m"]), ["m"])
    assert rows(alias.subloops(blocks, ["m"]), "r0", "r1", "n_blocks") == [(1, 2, 2), (3, 4, 2)]
    assert rows(alias.superloops(blocks, ["m"]), "period", "iterations", "hidden") == [(2, 2, True)]
    assert rows(alias.aliased(matrix(spark, {"A": [1, 3, 5], "B": [2, 4, 6]}), ["m"])) == [(0, False)]


def test_wrap_columns_equal_a_dense_matrix(spark):
    draw = random.Random(4)
    cases = []
    for case in range(12):
        times = draw.sample(range(100), 20)
        cases += [(case, "ABCD"[draw.randrange(4)], t) for t in times]
    found = {(r["m"], r["t"]): r["col"] for r in alias.wrap_columns(spark.createDataFrame(cases, "m int, path string, t long"), ["m"], "path", "t").collect()}
    for case in range(12):
        own = sorted((t, p) for c, p, t in cases if c == case)
        order = sorted({p for _, p in own}, key=lambda p: min(t for t, q in own if q == p))
        # Column by column, top down, take what comes next in time as long as its row is the one at hand or below.
        col, at, expected = 0, -1, {}
        for t, p in own:
            if order.index(p) <= at:
                col += 1
            at = order.index(p)
            expected[case, t] = col
        assert {k: v for k, v in found.items() if k[0] == case} == expected


# Nesting


def test_containment(spark):
    def at(ts):
        return spark.createDataFrame([(0, t) for t in ts], "k int, t long")

    def contained(outer, inner, mode="all"):
        return nesting.contains(at(outer), at(inner), ["k"], "t", mode).first()["contained"]

    assert contained([10, 20, 30], [12, 15, 22])
    assert not contained([10, 20, 30], [20, 25])
    assert contained([10, 20, 30], [20, 25], "any")
    assert contained([10, 20], [5, 11, 99])


def test_iteration_bounds_thin_the_longer_list(spark):
    b = spark.createDataFrame([(0, t) for t in (1, 2, 3, 4)], "k int, t long")
    e = spark.createDataFrame([(0, t) for t in (10, 20)], "k int, t long")
    assert rows(nesting.iteration_bounds(b, e, ["k"], "t"), "iteration", "t_begin", "t_end") == [(0, 1, 10), (1, 3, 20)]
    assert nesting.merge_iterations(5, 10) == (2.0, False) and nesting.merge_iterations(5, 5) == (1.0, True)


# Occurrences


def test_calls_messages_counters(spark):
    marks = spark.createDataFrame([(0, 10, 1, True), (0, 15, 2, False), (0, 20, 3, True), (0, 21, 4, True), (0, 30, 5, False), (0, 31, 6, False)], "rank int, t long, n int, e boolean")
    calls = occurrences.pair_calls(marks, ["rank"], "t", ["n"], "e")
    assert rows(calls, "t_in", "t_out", "duration") == [(10, 15, 5), (21, 30, 9)]
    assert rows(occurrences.unpaired(marks, ["rank"], "t", ["n"], "e"), "t") == [(21,), (31,)]
    messages = spark.createDataFrame([(0, 3, 10, 99, 5), (0, 2, 10, 98, 7), (1, 0, 1, 30, 11)], "send_task int, recv_task int, t_send long, t_recv long, size long")
    assert rows(occurrences.match_messages(calls.select("rank", "t_in", "t_out"), messages), "t_in", "msg_size", "partners") == [(10, 12, [2, 3]), (21, 11, [1])]
    counters = spark.createDataFrame([(0, 10, 1), (0, 12, 2), (0, 15, 4), (0, 18, 8)], "rank int, t long, v long")
    edges = marks.where("t < 20").select("rank", "t", F.col("e").alias("is_entry"))
    assert rows(occurrences.attribute(counters, edges, ["rank"], "t", "v"), "scope", "total") == [("burst", 12), ("call", 3)]
    assert rows(occurrences.attribute(counters, edges, ["rank"], "t", "v", "shifted"), "scope", "total") == [("burst", 9), ("call", 6)]
    loops = spark.createDataFrame([(0, 7, 1, 0, 100), (0, 8, 2, 5, 18)], "rank int, loop long, level int, t_in long, t_out long")
    assert rows(occurrences.loop_stacks(calls.select("rank", "t_in"), loops, ["rank"], "t_in"), "t_in", "loop_stack") == [(10, [7, 8]), (21, [7])]


def test_marked_loops(spark):
    marks = [(0, 1, 5), (0, 2, 6), (0, 4, 0), (0, 6, 6), (0, 9, 0), (0, 10, 0)]
    df = spark.createDataFrame(marks, "rank int, t long, v long")
    found = loopstats.intervals(df, ["rank"], "t", [], "v")
    assert rows(found, "depth", "id", "t_in", "t_out") == [(1, 5, 1, 10), (2, 6, 2, 4), (2, 6, 6, 9)]
    inner = found.where("depth = 2").select("rank", "t_in")
    assert rows(loopstats.owner(inner, found.where("depth = 1"), ["rank"], "t_in"), "t_in", "owner") == [(2, 5), (6, 5)]
    stats = spark.createDataFrame([(0, "a.c:3", 5, 1.5, 0.1, {"ins": 2.0}), (0, "a.c:9", 1, 1.0, 0.0, {"cyc": 1.0})], "rank int, loop_loc string, total_iters long, iter_time_mean double, iter_time_std double, counter map<string,double>")
    assert rows(loopstats.csv_rows(stats, ["ins", "cyc"])) == [(0, "a.c:3", 5, 1.5, 0.1, 2.0, None)]


def test_report_file(spark, tmp_path):
    stats = spark.createDataFrame([(0, "a.c:3", 5, 1.5, 0.1, {"ins": 2.0})], "rank int, loop_loc string, total_iters long, iter_time_mean double, iter_time_std double, counter map<string,double>")
    loopstats.write_csv(stats, ["ins"], str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["Rank", "Loop loc.", "Total iters", "Iter time m", "Iter time std", "ins_mean"]


# Ranks, flow, alignment


def test_rank_blocks(spark):
    items = [(0, 0, [0, 1, 2]), (0, 1, [0, 1]), (0, 2, [0]), (0, 3, [0, 1]), (0, 4, [2]), (0, 5, [0, 1, 2])]
    df = spark.createDataFrame(items, "loop int, pos int, ranks array<int>")
    assert rows(ranks.nested_blocks(df, ["loop"]), "pos", "block") == [(0, []), (1, [0]), (2, [0, 0]), (3, [0]), (4, [1]), (5, [])]
    assert rows(ranks.flat_blocks(df, "pos", "ranks", ["loop"]), "block", "n_items") == [(k, 1) for k in range(6)]
    loops = spark.createDataFrame([(0, "a", 0, 1, False), (0, "a", 1, 2, False), (0, None, 0, 3, True), (0, "a", 1, 4, False)], "l int, p string, r int, o int, is_loop boolean")
    assert rows(ranks.compact(loops.where("p is not null or is_loop"), ["l"], "p", "r", "o", "is_loop"), "segment", "p", "ranks") == [(0, "a", [0, 1]), (1, "a", [1]), (1, None, [0])]


def test_flow_and_alignment(spark):
    steps = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "a", 3), (1, "a", 1), (1, "b", 2), (1, "c", 3)], "r int, n string, t int")
    edges = flow.edges(steps, "r", "n", "t", [])
    assert rows(edges) == [("a", "b", [0, 1], 2), ("b", "a", [0], 1), ("b", "c", [1], 1)]
    assert rows(flow.ends(edges)) == [("a", False, False), ("b", False, False), ("c", False, True)]
    stacks = spark.createDataFrame([(0, ["m", "f", "x"]), (1, ["f", "y"]), (2, ["x", "z"])], "k int, p array<string>")
    assert rows(flow.pivot(stacks.where("k < 2"), "p", "k")) == [("f", 2)]
    aligned = flow.align(stacks, "p", "f")
    assert rows(aligned, "k", "height", "pad") == [(0, 2, 0), (1, 1, 1)]
    rest = spark.createDataFrame([(7, ["q", "x"]), (8, ["f", "y"]), (9, ["none"])], "k int, p array<string>")
    assert rows(flow.place_rest(rest, aligned, "p", "k")) == [(7, 2, 1), (8, 1, 0)]


# Phases and clusters


def test_islands_and_components_against_brute_force(spark):
    draw = random.Random(9)
    points = [(k, round(draw.random() * (3 if k % 3 else 1), 3), round(draw.random(), 3)) for k in range(150)]
    df = spark.createDataFrame(points, "k int, x double, y double")
    islands = {r["k"]: r["phase_id"] for r in phases.islands(df, "x", 0.02).collect()}
    number, last = -1, -math.inf
    for x, k in sorted((x, k) for k, x, _ in points):
        number += x - last > 0.02
        last = x
        assert islands[k] == number
    found = {r["k"]: r["c"] for r in clustering.eps_components(df, "x", "y", 0.08, "c").collect()}
    parent = {k: k for k, *_ in points}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, ax, ay in points:
        for b, bx, by in points:
            if a < b and (ax - bx) ** 2 + (ay - by) ** 2 <= 0.08**2:
                parent[root(b)] = root(a)
    assert all((found[a] == found[b]) == (root(a) == root(b)) for a, *_ in points for b, *_ in points)


def test_shares_that_fit(spark):
    points = [(n, share * 1000 / n) for share in (0.2, 0.6) for n in range(2, 42)]
    df = spark.createDataFrame(points, "n long, gap_mean double")
    assert phases.fit_shares(df, 1000.0, [k / 10 for k in range(1, 10)]) == [0.2, 0.6]


# Whole programs


def tree(structure):
    loops = {r["loop"]: r for r in structure.loops.collect()}
    items = {}
    for r in structure.items.collect():
        items.setdefault(r["loop"], []).append((r["key"][-2]["line"], r["key"][-1]["fn"], r["ranks"]))
    return loops, {k: sorted(v) for k, v in items.items()}


def test_one_loop(spark):
    found = infer(tracegen.collectives().frame(spark))
    loops, items = tree(found)
    assert [(x["iterations"], x["parent"]) for x in loops.values()] == [(50.0, None)]
    assert items[0] == [(29, "MPI_Reduce", [0, 1, 2]), (31, "MPI_Alltoall", [0, 1, 2])]


def test_nested_loops(spark):
    found = infer(tracegen.triple_nest().frame(spark), phase_radius=0.5)
    loops, items = tree(found)
    by_size = sorted(loops.values(), key=lambda x: x["original_iterations"])
    assert [x["original_iterations"] for x in by_size] == [5, 25, 125]
    assert [x["iterations"] for x in by_size] == [5.0, 5.0, 5.0]
    assert by_size[0]["parent"] is None and by_size[1]["parent"] == by_size[0]["loop"] and by_size[2]["parent"] == by_size[1]["loop"]
    text = [r["text"] for r in render.text_of(render.lines_of(found)).collect()]
    assert sum("FOR 1 TO 5 " in x for x in text) == 3 and sum("END LOOP" in x for x in text) == 3
    assert next(k for k, x in enumerate(text) if "MPI_Comm_size" in x) < next(k for k, x in enumerate(text) if "MPI_Bcast" in x)


def test_ranks_apart(spark):
    found = infer(tracegen.parity().frame(spark))
    loops, items = tree(found)
    assert len(loops) == 1 and items[0] == [(40, "MPI_Send", [0, 2]), (42, "MPI_Send", [1, 3]), (44, "MPI_Recv", [0, 2]), (46, "MPI_Recv", [1, 3]), (50, "MPI_Barrier", [0, 1, 2, 3])]
    codes = [r["code"] for r in render.lines_of(found).collect()]
    assert [c for c in codes if c.startswith(("IF", "EL"))] == ["IF rank in [0,2]", "ELSE"] * 2
    shown = [r["code"] for r in render.lines_of(found, shown=[1], leaf_only=True).collect()]
    assert shown == ["FOR 1 TO 40 [id=0.0]", "IF rank in [1,3]", "MPI_Send()", "MPI_Recv()", "MPI_Barrier()", "END LOOP [id=0.0]"]


def test_ranks_within_ranks(spark):
    codes = [(r["depth"], r["code"]) for r in render.lines_of(infer(tracegen.parts().frame(spark)), leaf_only=True).collect()]
    assert codes[1:-1] == [
        (1, "MPI_Barrier()"), (1, "IF rank in [0,1,2]"), (2, "MPI_Send()"), (2, "IF rank in [1]"), (3, "MPI_Bcast()"), (2, "MPI_Recv()"), (1, "ELSE"), (2, "MPI_Wait()"), (1, "MPI_Barrier()"),
    ]


def test_a_condition_on_data(spark):
    found = infer(tracegen.conditioned().frame(spark))
    assert [(r["iterations"], r["parent"]) for r in found.loops.collect()] == [(30.0, None)]
    codes = [r["code"] for r in render.lines_of(found, leaf_only=True).collect()]
    assert codes[1:-1] == ["MPI_Send()", "50% => MPI_Bcast()", "MPI_Recv()"]


def test_from_the_text_of_a_trace_to_pseudo_code(spark):
    numbers: dict[str, int] = {}
    program = tracegen.conditioned()
    lines = spark.createDataFrame([(x, k) for k, x in enumerate(tracegen.text_of(program, numbers))], "value string, line_no long").repartition(3)
    labels = spark.createDataFrame([(kind, v, fn) for fn, v in numbers.items() for kind in ("50000001", "70000001", "70000002")], "event_type string, value long, label string")
    events = trace.translate(trace.events_of(lines).withColumnRenamed("type", "event_type"), labels).withColumnRenamed("event_type", "type")
    calls = callstacks.occurrences_of(events, trace.messages_of(lines))
    made, given = ({(r["rank"], r["t"], r["t_out"], tuple((f["fn"], f["line"]) for f in r["path"])) for r in df.collect()} for df in (calls, program.frame(spark)))
    assert made == given
    found = infer(calls)
    shown = {r["code"]: (r["file"], r["e_time"], r["e_size"], r["e_ipc"]) for r in render.lines_of(found, leaf_only=True).collect()}
    assert shown["MPI_Send(0:1 1:0)"] == ("libmpi", "100.0ns", "4.0KB", "1.5")
    assert shown["50% => MPI_Bcast(CommId:3)"] == ("libmpi", "100.0ns", "2.0KB/500.0B", "1.5")
    bursts = [r for r in render.lines_of(found, bursts=True).collect() if r["code"] == "[~ computation ~]"]
    assert len(bursts) == 3 and {r["e_ipc"] for r in bursts} == {"0.25"}
    assert len(bursts) > len([r for r in render.lines_of(found, least_burst=950.0).collect() if r["code"] == "[~ computation ~]"])
    with pytest.raises(ValueError, match="bursts"):
        render.lines_of(infer(program.frame(spark)), bursts=True)


def test_hidden_loop(spark):
    program = tracegen.hidden_parent().frame(spark)
    found = infer(program)
    loops, items = tree(found)
    hidden = [x for x in loops.values() if x["hidden"]]
    assert [x["iterations"] for x in hidden] == [20.0]
    inside = [x for x in loops.values() if x["parent"] == hidden[0]["loop"]]
    assert [x["iterations"] for x in inside] == [10.0, 10.0]
    out = io.StringIO()
    sh = shell.Shell(found, program, stdout=out)
    for line in ("pseudocode", "pseudocode wo-cs", "clustering", "pseudocode nonsense", "show 0 3"):
        sh.onecmd(line)
    assert "FOR 1 TO 20" in out.getvalue() and "cluster 0" in out.getvalue() and sh.onecmd("q")


def test_no_occurrences_have_no_loops(spark):
    found = infer(spark.createDataFrame([], tracegen.SCHEMA), total=100.0)
    assert found.loops.count() == 0 and render.lines_of(found).count() == 0


# Streams


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k % 3, f"p{k % 2}", 1000 * k + k % 7, k) for k in range(200)], "rank int, path string, t long, cents long").withColumn("ts", F.timestamp_micros(F.col("t") * 1_000_000))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = online.reduce_online(stream, ["rank", "path"], "t", "cents").writeStream.outputMode("complete").format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    out = ["rank", "path", "n", "t_first", "t_last", "gap_mean", F.round("cents_mean", 6)]
    batch = reduction.reduce_paths(df, ["rank", "path"], "t", ("cents",), medians=False)
    assert rows(spark.table("online"), *out) == rows(batch, *out)
    assert online.sessions(df, "1 hours").count() == 3
    assert rows(online.windows(df, "1 hour").agg(F.sum("n"))) == [(200,)]
    nested = df.select("rank", "path", "t").withColumn("around", F.array(F.col("rank").cast("string"), F.col("path").cast("string"), F.col("t").cast("string")))
    kept = {tuple(r["around"]) for r in online.kept_by_sampling(nested, 0.9, "around").collect()}
    around = {tuple(r["a"]) for r in online.kept_by_sampling(nested.select(F.slice("around", 1, 2).alias("a")).distinct(), 0.9, "a").collect()}
    assert 0 < len(kept) < 200 and {k[:2] for k in kept} <= around
    sends = df.select(F.col("cents").alias("message"), "ts", F.col("rank").alias("task"))
    assert online.match_messages(sends, sends, "1 hour", "1 hour").count() == 200
