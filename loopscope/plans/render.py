"""Loops as pseudo-code: one line a loop, call or condition, with where, how long, how large and how fast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopscope.functions import paths, scalars
from loopscope.plans.inference import Structure

#: Widths of the six columns of the table.
WIDTHS = (20, 6, 44, 14, 16, 8)


def _shown(items: DataFrame, shown: list[int] | None) -> DataFrame:
    """``items`` with the texts of their lines: e_time, e_size, e_ipc, code, and those of the burst before."""
    mean = lambda m: F.col(f"{m}_mean") if f"{m}_mean" in items.columns else F.lit(None).cast("double")
    ratio = lambda a, b: F.coalesce(F.round(mean(a) / F.nullif(mean(b), F.lit(0)), 2).cast("string"), F.lit("-"))
    fn = F.element_at("key", -1)["fn"]
    collective, known = paths.is_collective(fn), mean("communicator").isNotNull()
    none = F.coalesce(mean("send_size") + mean("recv_size"), F.lit(0.0)) == 0
    both = F.when(none, "-").otherwise(F.concat(scalars.scale_bytes(mean("send_size"), True), F.lit("/"), scalars.scale_bytes(mean("recv_size"), True)))
    pairs = F.col("partners") if "partners" in items.columns else F.lit(None).cast("array<struct<rank:int,partners:array<bigint>>>")
    ranks = F.array(*[F.lit(r) for r in shown]) if shown is not None else F.col("ranks")
    with_partners = F.concat(fn, F.lit("("), F.coalesce(scalars.partners_text(F.filter(pairs, lambda p: ~F.array_contains(p["partners"], -1)), ranks), F.lit("")), F.lit(")"))
    return items.select(
        "loop", "key", "ranks", "n",
        F.transform("key", lambda f: f["line"]).alias("lines"),
        (F.col("files") if "files" in items.columns else F.lit(None).cast("array<string>")).alias("files"),
        F.when(collective & known, scalars.collective_label(fn, mean("communicator"))).otherwise(with_partners).alias("code"),
        scalars.scale_time(mean("duration")).alias("e_time"),
        F.when(collective, both).otherwise(scalars.scale_bytes(mean("msg_size"))).alias("e_size"),
        ratio("ins", "cyc").alias("e_ipc"),
        mean("burst_ns").alias("burst"), scalars.scale_time(mean("burst_ns")).alias("burst_time"), ratio("burst_ins", "burst_cyc").alias("burst_ipc"),
    )


class _Conditions:
    """The conditions on ranks that are open along the calls of one loop, and those beside them."""

    def __init__(self, everyone: frozenset):
        self.open, self.beside = [everyone], [[]]

    def enter(self, own: frozenset) -> str | None:
        """The line that opens the block of a call on these ranks; None if it is open already."""
        while len(self.open) > 1 and not own <= self.open[-1]:
            self.open.pop()
            self.beside.pop()
        if own == self.open[-1]:
            self.beside[-1] = []
            return None
        chain = self.beside[-1]
        ranks = "rank in [" + ",".join(map(str, sorted(own))) + "]"
        if chain and not any(own & x for x in chain):
            line = "ELSE" if frozenset().union(own, *chain) == self.open[-1] else f"ELIF {ranks}"
        else:
            chain.clear()
            line = f"IF {ranks}"
        chain.append(own)
        self.open.append(own)
        self.beside.append([])
        return line

    @property
    def depth(self) -> int:
        return len(self.open) - 1


def lines_of(structure: Structure, *, shown: list[int] | None = None, leaf_only: bool = False, bursts: bool = False, least_burst: float | None = None) -> DataFrame:
    """(pos, depth, file, line, code, e_time, e_size, e_ipc): depth first, loops and calls in program order.

    ``shown`` keeps the calls of these ranks only; ``leaf_only`` leaves out the frames on the way to
    a call; ``bursts`` puts a line for the computation before each call, of those whose mean is
    ``least_burst`` at least. Calls on a part of the ranks stand under a condition, nested where one
    part holds another. Loops and paths are as many as the program has.
    """
    spark = structure.loops.sparkSession
    if (bursts or least_burst is not None) and "burst_ns_mean" not in structure.items.columns:
        raise ValueError("the occurrences have no bursts (burst_ns)")
    loops = {r["loop"]: r for r in structure.loops.collect()}
    rows = structure.items
    everyone = frozenset(r["r"] for r in rows.select(F.explode("ranks").alias("r")).distinct().collect())
    if shown is not None:
        rows = rows.where(F.arrays_overlap("ranks", F.array(*[F.lit(r) for r in shown])))
    calls = _shown(rows, shown).collect()

    def home(loop: int) -> int:
        while loops[loop]["merged"]:
            loop = loops[loop]["parent"]
        return loop

    children: dict[int | None, list] = {}
    for r in calls:
        children.setdefault(home(r["loop"]), []).append((tuple(r["lines"]), 1, r))
    for k in sorted((k for k in loops if not loops[k]["merged"]), key=lambda k: -_depth(loops, k)):
        first = min((c[0] for c in children.get(k, [])), default=None)
        if first is not None:
            parent = loops[k]["parent"]
            children.setdefault(None if parent is None else home(parent), []).append((first, 0, k))
    out: list[tuple] = []

    def add(depth: int, file: str | None, line: int | None, code: str, time: str = "", size: str = "-", ipc: str = "-") -> None:
        out.append((len(out), depth, file, line, code, time, size, ipc))

    def show(owner: int | None, depth: int) -> None:
        before: tuple = ()
        conditions = _Conditions(everyone)
        for _, kind, x in sorted(children.get(owner, []), key=lambda c: (c[0], c[1], str(c[2]))):
            if kind == 0:
                conditions, before = _Conditions(everyone), ()
                add(depth, None, None, f"FOR 1 TO {loops[x]['iterations']:g} [id={loops[x]['cluster_id']}.{x}]")
                show(x, depth + 1)
                add(depth, None, None, f"END LOOP [id={loops[x]['cluster_id']}.{x}]")
                continue
            line = conditions.enter(frozenset(x["ranks"]))
            inner = depth + conditions.depth
            if line:
                add(inner - 1, None, None, line)
                before = ()
            frames, files = [(f["fn"], f["line"]) for f in x["key"]], x["files"] or [None] * len(x["key"])
            hidden = next((k for k, (a, b) in enumerate(zip(frames, before)) if a != b), min(len(frames), len(before)))
            if not leaf_only:
                for k, (fn, at) in enumerate(frames[hidden:-1], hidden):
                    add(inner + k, files[k], at, f"{fn}()")
            below = inner + (0 if leaf_only else len(frames) - 1)
            if (bursts or least_burst is not None) and x["burst"] is not None and x["burst"] >= (least_burst or 0):
                add(below, files[-1], frames[-1][1], "[~ computation ~]", x["burst_time"], "-", x["burst_ipc"])
            chance = x["n"] / loops[x["loop"]]["original_iterations"] if loops[x["loop"]]["original_iterations"] else 1
            add(below, files[-1], frames[-1][1], x["code"] if chance >= 1 else f"{chance:.0%} => {x['code']}", x["e_time"], x["e_size"], x["e_ipc"])
            before = tuple(frames)

    show(None, 0)
    return spark.createDataFrame(out, "pos long, depth int, file string, line int, code string, e_time string, e_size string, e_ipc string")


def _depth(loops: dict, k: int) -> int:
    depth = 0
    while loops[k]["parent"] is not None:
        k, depth = loops[k]["parent"], depth + 1
    return depth


def cell(x: Column, width: int, left: bool = True) -> Column:
    """A text of one width, cut or padded."""
    cut = F.substring(F.coalesce(x.cast("string"), F.lit("")), 1, width)
    return F.rpad(cut, width, " ") if left else F.lpad(cut, width, " ")


def text_of(lines: DataFrame) -> DataFrame:
    """(pos, text): the table's rows, code indented by its depth."""
    code = F.concat(F.repeat(F.lit(": "), F.col("depth")), F.col("code"))
    parts = [cell(F.col("file"), WIDTHS[0]), cell(F.col("line"), WIDTHS[1], False), cell(code, WIDTHS[2]), *(cell(F.col(c), w, False) for c, w in zip(("e_time", "e_size", "e_ipc"), WIDTHS[3:], strict=True))]
    return lines.select("pos", F.concat_ws(" ", *parts).alias("text")).orderBy("pos")


#: Ways to put out the lines; more can be added.
RENDERERS = {"text": text_of, "rows": lambda lines: lines.orderBy("pos")}


def rendered(structure: Structure, renderer: str = "text", **filters) -> DataFrame:
    """The structure by one of RENDERERS, under the filters of ``lines_of``."""
    return RENDERERS[renderer](lines_of(structure, **filters))
