"""Occurrences and trace texts of small programs, made by rule."""

from __future__ import annotations

SCHEMA = "rank int, t long, t_out long, path array<struct<fn:string,line:int,file:string>>"


class Program:
    """Calls of some ranks, each a step after the one before on its rank."""

    def __init__(self, ranks: int, step: int = 1000, cost: int = 100):
        self.ranks, self.step, self.cost, self.rows = ranks, step, cost, []
        self.now = [step] * ranks

    def call(self, rank: int, leaf: str, *frames: tuple[str, int]) -> None:
        path = [{"fn": fn, "line": line, "file": "a.c"} for fn, line in frames] + [{"fn": leaf, "line": 0, "file": "libmpi"}]
        self.rows.append((rank, self.now[rank], self.now[rank] + self.cost, path))
        self.now[rank] += self.step

    def frame(self, spark):
        return spark.createDataFrame(self.rows, SCHEMA)


def conditioned(n: int = 30) -> Program:
    """A call in every other iteration, between two that all iterations make."""
    p = Program(2)
    for rank in range(2):
        for k in range(n):
            p.call(rank, "MPI_Send", ("main", 10))
            if k % 2:
                p.call(rank, "MPI_Bcast", ("main", 12))
            p.call(rank, "MPI_Recv", ("main", 14))
    return p


def parts(n: int = 20) -> Program:
    """Calls of all ranks, of three of four, and of one of these."""
    p = Program(4)
    for rank in range(4):
        for k in range(n):
            p.now[rank] = (10 * k + 1) * p.step
            p.call(rank, "MPI_Barrier", ("main", 10))
            if rank < 3:
                p.call(rank, "MPI_Send", ("main", 12))
                if rank == 1:
                    p.call(rank, "MPI_Bcast", ("main", 14))
                p.call(rank, "MPI_Recv", ("main", 16))
            else:
                p.call(rank, "MPI_Wait", ("main", 18))
            p.call(rank, "MPI_Barrier", ("main", 20))
    return p


def text_of(program: Program, numbers: dict[str, int]) -> list[str]:
    """The records of a program's calls, each followed by its end; what they sent goes to the next rank."""
    out = []
    for rank, t, t_out, path in program.rows:
        call = numbers.setdefault(path[-1]["fn"], len(numbers) + 1)
        frames = "".join(f":7000000{k}:{numbers.setdefault(f['fn'], len(numbers) + 1)}:8000000{k}:{f['line']}" for k, f in enumerate(reversed(path[:-1]), 1))
        sizes = ":50100001:2000:50100002:500:50100004:3" if path[-1]["fn"] == "MPI_Bcast" else ""
        out.append(f"2:1:1:{rank + 1}:1:{t}:50000001:{call}{frames}:42000050:300:42000059:200{sizes}")
        out.append(f"2:1:1:{rank + 1}:1:{t_out}:50000001:0:42000050:1000:42000059:4000")
        if path[-1]["fn"] == "MPI_Send":
            other = (rank + 1) % program.ranks
            out.append(f"3:1:1:{rank + 1}:1:{t}:{t}:1:1:{other + 1}:1:-1:-1:4096:0")
    return out


def triple_nest(n: int = 5) -> Program:
    p = Program(2)
    for rank in range(2):
        for _ in range(n):
            p.call(rank, "MPI_Comm_size", ("main", 20))
            for _ in range(n):
                p.call(rank, "MPI_Comm_size", ("main", 23))
                for _ in range(n):
                    for line in (26, 27, 28):
                        p.call(rank, "MPI_Bcast", ("main", line))
    return p


def collectives(n: int = 50) -> Program:
    p = Program(3)
    for rank in range(3):
        p.call(rank, "MPI_Init", ("main", 5))
        for _ in range(n):
            p.call(rank, "MPI_Reduce", ("main", 29))
            p.call(rank, "MPI_Alltoall", ("main", 31))
    return p


def parity(n: int = 40) -> Program:
    """Even and odd ranks call on lines of their own, all meet at a barrier."""
    p = Program(4)
    for rank in range(4):
        for _ in range(n):
            a, b = (40, 44) if rank % 2 == 0 else (42, 46)
            p.call(rank, "MPI_Send", ("main", a))
            p.call(rank, "MPI_Recv", ("main", b))
            p.call(rank, "MPI_Barrier", ("main", 50))
    return p


def hidden_parent(n: int = 20, inner: int = 10) -> Program:
    """Two loops one after the other, in an outer loop that calls nothing itself."""
    p = Program(2)
    for rank in range(2):
        for _ in range(n):
            for _ in range(inner):
                p.call(rank, "MPI_Send", ("main", 10))
                p.call(rank, "MPI_Recv", ("main", 11))
            for _ in range(inner):
                p.call(rank, "MPI_Bcast", ("main", 20))
                p.call(rank, "MPI_Barrier", ("main", 21))
    return p


TRACE = """\
#Trace (01/02/2020 at 10:11):5000_ns:1(2):1:2(1:1,1:1)
c:1:1:2:1:2
1:1:1:1:1:0:500:1
2:1:1:1:1:1000:50000001:2:70000001:1:80000001:1:70000002:2:80000002:2:42000050:10:12345678:9
2:1:1:1:1:1500:50000001:0:42000050:30
2:1:1:2:1:1100:50000001:3
2:1:1:2:1:1700:50000001:0
3:1:1:1:1:1000:1001:2:1:2:1:1700:1701:64:7
2:1:1:1:1:2000:99000001:5
2:1:1:1:1:3000:99000001:0
x:bad
"""

DICTIONARY = """\
DEFAULT_OPTIONS

LEVEL THREAD

EVENT_TYPE
9    50000001    MPI Point-to-point
VALUES
2   MPI_Send
3   MPI_Recv
0   End

EVENT_TYPE
0    70000001    Caller at level 1
0    70000002    Caller at level 2
VALUES
1   work [real_work]
2   main

EVENT_TYPE
7  42000050 PAPI_TOT_INS [Instr completed]

GRADIENT_COLOR
0 {0,0,0}
"""
