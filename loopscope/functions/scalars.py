"""Column functions over numbers and texts of reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of times and sizes.
NS_UNITS, BYTE_UNITS = ("ns", "us", "ms", "s"), ("B", "KB", "MB", "GB", "TB")


def _ladder(x: Column, step: int, units: tuple[str, ...], strict: bool) -> Column:
    """x over the largest power of ``step`` that leaves it at 1 (or over 1), to 2 digits, and the unit of that power."""
    out = None
    for k, unit in enumerate(units):
        text = F.concat(F.round(x / float(step**k), 2).cast("string"), F.lit(unit))
        out = text if out is None else F.when(x > float(step**k) if strict else x >= float(step**k), text).otherwise(out)
    return out


def scale_time(ns: Column) -> Column:
    """Nanoseconds as text, over 1000 while at least that."""
    return _ladder(ns.cast("double"), 1000, NS_UNITS, False)


def scale_bytes(n: Column, collective: bool = False) -> Column:
    """Sizes as text: messages over 1024 while more than that, collective calls over 1000 while at least that; zero is a dash."""
    text = _ladder(n.cast("double"), 1000 if collective else 1024, BYTE_UNITS, not collective)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("-")).otherwise(text)


def uid(text: Column) -> Column:
    """The 32-bit string hash by which loops are known: h = 33 h + byte from 5381 on."""
    # Two hexadecimal digits a byte, since a character beyond ASCII has several.
    digits = F.hex(F.encode(text, "UTF-8"))
    places = F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))
    codes = F.when(F.length(digits) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(places, lambda k: F.conv(F.substr(digits, k, F.lit(2)), 16, 10).cast("long")))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(4294967295)))


def reconstructed(n: Column, alpha: float, level: Column) -> Column:
    """Iterations that ran, from those observed at a nesting level when each is kept with probability alpha."""
    return n / F.pow(F.lit(alpha), level + 1)


def cost(n: Column, total: float | Column, gap: Column, share: float | Column) -> Column:
    """Repetitions over those that would explain ``share`` of the run."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return n - of(total) * of(share) / gap


def set_relation(a: Column, b: Column) -> Column:
    """How set a stands to set b: equal, subset, superset, disjoint or overlap."""
    a_less, b_less = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    apart = F.size(F.array_intersect(a, b)) == 0
    cases = [(a_less & b_less, "equal"), (a_less, "subset"), (b_less, "superset"), (apart, "disjoint")]
    return reduce(lambda out, c: F.when(c[0], F.lit(c[1])).otherwise(out), reversed(cases), F.lit("overlap"))


def collective_label(name: Column, communicator: Column) -> Column:
    return F.format_string("%s(CommId:%d)", name, communicator.cast("int"))


def partners_text(pairs: Column, shown: Column) -> Column:
    """``from:to,to`` of each (rank, partners) pair whose rank is shown, without absent partners (-1)."""
    own = F.filter(pairs, lambda p: F.array_contains(shown, p["rank"]))
    text = F.transform(own, lambda p: F.concat(p["rank"].cast("string"), F.lit(":"), F.array_join(F.transform(F.filter(p["partners"], lambda x: x != -1), lambda x: x.cast("string")), ",")))
    return F.array_join(text, " ")
