"""Fuzzy line deduplication, in DataFrame functions only.

Lines are normalised to their words (lower case, blanks between them). A line's SimHash has 60 bits
over its words of six letters and more, or over three characters at a time where it has few words.
Any two lines that differ in at most five bits are candidates: every line has 63 keys, each of about
half of its bits, of which two such lines always share one (see ``_masks``), and no candidate is lost
however many lines share a key (see ``groups``). Candidates are verified by the edit similarity of
the normalised lines, at their full length. Of each connected group of lines one occurrence is kept:
the first by document and place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopscope.llm import groups
from loopscope.llm.components import connected
from loopscope.llm.tables import Stored, setting

#: Differing bits and edit similarity of linked lines.
BITS, SIMILARITY = 5, 0.8
#: Fewest words of a line that is matched by them, and characters of one that is matched by these; other lines are matched as they are.
LEAST_WORDS, LEAST_CHARS = 5, 24
#: Letters of the words that a fingerprint is over; lines with fewer than LEAST_WORDS such count each of their words once, so that
#: what parts the cells of a table does not outweigh them.
LONG = 6
#: Lines of one key that are paired; keys with more go by pivots.
PAIRED = groups.PAIRED
#: Edit distances that are looked for first, since near copies are found within narrow bands.
BANDS = (16, 128, 1024)
#: Different words that can be written as one character each.
CODES = 255

#: Bits of a fingerprint, and bundles of keys that are gathered at once, which bounds what is in memory and on disk.
WIDTH, RUN = 60, 9
#: Free bits of the vectors of a bundle, at most; fingerprints that come together, were they spread evenly, and how many of them make the bundles smaller.
FREE, GATHERED, MOST_GATHERED = 2, 1 << 14, 1 << 17
#: Keys, or places of lines, that are handed to all tasks, at most (some 25 MB); more are joined by sorting.
HANDED = 500_000
#: Bits for a place among gathered fingerprints, and how many groups an aggregate of lists takes before it sorts its rows.
_PLACE, _FALLBACK = 28, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
#: A one in each of 15 half bytes, the lower halves of eight bytes, hashes that a half byte can count, and parts of as many hashes that are counted at once.
_HALVES, _NIBBLES, _FEW, _PARTS = 0x111111111111111, 0x0F0F0F0F0F0F0F0F, 15, 8
#: Hashes that a byte can count with room for a sign.
_MOST = 127

#: SQL of a text in lower case with plain blanks, and of the words of its variable ``line``.
PLAIN = r"replace(replace(lower({}), '\t', ' '), '\r', ' ')"
WORDS = "array_remove(split(line, ' '), '')"


def _once(made: str, name: str, out: str) -> str:
    """SQL of ``out``, in which ``name`` is what ``made`` is, made once."""
    return f"transform(array({made}), {name} -> {out})[0]"


def hashes_of(words: str) -> str:
    """SQL for the hashes that a line's fingerprint is over, null if it is matched as it is."""
    long = _once(f"filter({words}, w -> char_length(w) >= {LONG})", "l", f"transform(if(size(l) >= {LEAST_WORDS}, l, array_distinct({words})), w -> xxhash64(w))")
    threes = f"if(size(cs) >= {LEAST_CHARS}, transform(sequence(0, size(cs) - 3), i -> xxhash64(cs[i], cs[i + 1], cs[i + 2])), null)"
    return f"if(size({words}) >= {LEAST_WORDS}, {long}, {_once(f"split(array_join({words}, ' '), '')", 'cs', threes)})"


def _parts(hashes: str, n: int) -> str:
    """SQL for a column of hashes in parts of up to ``n``."""
    return f"transform(sequence(0, (size({hashes}) - 1) div {n}), c -> slice({hashes}, c * {n} + 1, {n}))"


def _lanes(hashes: str) -> str:
    """SQL for eight numbers whose bytes count bits of up to 127 hashes: byte j of number k bit 8 j + k. Half bytes count 15 hashes first."""
    halves = [f"aggregate(few, 0L, (s, x) -> s + (shiftrightunsigned(x, {k}) & {_HALVES}L))" for k in range(4)]
    lanes = [f"aggregate(hs, 0L, (t, h) -> t + (shiftrightunsigned(h[{k}], {high}) & {_NIBBLES}L))" for high in (0, 4) for k in range(4)]
    return _once(f"transform({_parts(hashes, _FEW)}, few -> array({', '.join(halves)}))", "hs", f"array({', '.join(lanes)})")


def _counted(hashes: str) -> str:
    """SQL for the fingerprint of up to 120 hashes, without lambda functions, so that it is compiled where it stands apart from such."""
    parts = [range(_FEW * p, _FEW * (p + 1)) for p in range(_PARTS)]
    halves = [[" + ".join(f"(shiftrightunsigned(coalesce(get({hashes}, {i}), 0L), {k}) & {_HALVES}L)" for i in part) for part in parts] for k in range(4)]
    # Byte j of the bytes of half byte lane k counts bit 8 j + k, or 8 j + 4 + k; over half the hashes reach bit 6 of it with 63 less half added.
    ones = _NIBBLES // 15
    out = []
    for k, lanes in enumerate(halves):
        for high in (0, 4):
            total = " + ".join(f"(shiftrightunsigned({lane}, {high}) & {_NIBBLES}L)" for lane in lanes)
            over = f"shiftrightunsigned({total} + (63 - least(size({hashes}), {_FEW * _PARTS}) div 2) * {ones}L, 6) & {ones}L"
            out.append(f"shiftleft({over}, {high + k})")
    return " | ".join(out)


def simhash(hashes: str, counted: str | None = None) -> str:
    """SQL for the fingerprint of a column of hashes: each bit is set if it is in over half of them; null without hashes.

    ``counted`` is a column that has that of few hashes already.
    """
    total = "aggregate(ps, 0L, (t, ls) -> t + (shiftrightunsigned(ls[b % 8], 8 * cast(b div 8 as int)) & 255L))"
    many = _once(f"transform({_parts(hashes, _MOST)}, part -> {_lanes('part')})", "ps", f"aggregate(sequence(0, {WIDTH - 1}), 0L, (s, b) -> s | if(2 * {total} > size({hashes}), shiftleft(1L, b), 0L))")
    few = f"size({hashes}) <= {_FEW * _PARTS}"
    if counted:
        # Used twice, the column stays in a projection of its own.
        return f"if({hashes} is null, null, if({few} and {counted} is not null, {counted}, {many}))"
    # Not in branches, in which what is used twice would be made twice.
    return f"((({_counted(hashes)}) & if({hashes} is null, null, if({few}, -1L, 0L))) | if({hashes} is null or {few}, 0L, {many}))"


def _lines(own: DataFrame) -> DataFrame:
    """(id, pos, h, g, fp): the lines of (id, text) that have words; fp is null for those that are matched as they are.

    A line is known by h and g together, 96 bits over its words.
    """
    # Words are taken outside of lambda functions, so that this is compiled.
    parts = own.select("id", F.posexplode(F.expr(f"split({PLAIN.format('text')}, '\\n')")).alias("pos", "line")).where(F.trim("line") != "")
    lines = parts.select("id", "pos", F.expr(WORDS).alias("ws"))
    # One string is hashed faster than its words; they have no blanks.
    hashed = lines.select("id", "pos", F.array_join("ws", " ").alias("norm"), F.expr(hashes_of("ws")).alias("hs"))
    hashed = hashed.select("id", "pos", F.xxhash64("norm").alias("h"), F.hash("norm").alias("g"), "hs", F.expr(_counted("hs")).alias("few"))
    return hashed.select("id", "pos", "h", "g", F.expr(simhash("hs", "few")).alias("fp"))


def _similar(a: str, b: str) -> Column:
    """Whether two normalised lines have the edit similarity wanted.

    Lines are as far apart as their lengths at least, which is looked at first, of the whole lines. Those of as
    many words are compared word by word. If that does not do, words that both begin with, and then those that
    both end with, are taken off. Lines of which few words differ are near, whatever these are; what is left is
    compared within bands about the diagonal, narrow ones first.
    """
    # Word by word, lines of as many words are at least as near as their words' distances say.
    most = "if(size(v.a) = size(v.b), aggregate(zip_with(v.a, v.b, (p, q) -> if(p = q, 0, levenshtein(p, q))), 0, (s, x) -> s + x), null)"
    same = "coalesce(nullif(array_position(zip_with({x}, {y}, (p, q) -> coalesce(p = q, false)), false), 0) - 1, size({x}))"
    head = same.format(x="v.a", y="v.b")
    tail = "least(" + same.format(x="reverse(u.a)", y="reverse(u.b)") + ", size(u.a), size(u.b))"
    # A changed word costs its letters and a blank at most, so that lines are at least as near as the edit distance of their words says, each written as one character.
    coded = "array_join(transform({x}, w -> chr(array_position(d, w))), '')"
    changes = "cast(u.limit div array_max(transform(d, w -> char_length(w) + 1)) as int)"
    few = _once("array_distinct(concat(u.a, u.b))", "d", f"if(size(d) <= {CODES}, levenshtein({coded.format(x='u.a')}, {coded.format(x='u.b')}, {changes}) >= 0, false)")
    limit = f"cast(floor((1 - {SIMILARITY}) * greatest(char_length({a}), char_length({b})) + 1e-9) as int)"
    within = " or ".join(["levenshtein(m.a, m.b, least(m.limit, {})) >= 0".format(BANDS[0]), *(f"(m.limit > {n} and levenshtein(m.a, m.b, least(m.limit, {more})) >= 0)" for n, more in zip(BANDS, [*BANDS[1:], "m.limit"], strict=True))])
    steps = [
        "array(v)",
        f"v -> named_struct('p', {head}, 'a', v.a, 'b', v.b, 'limit', v.limit)",
        "v -> named_struct('a', slice(v.a, v.p + 1, size(v.a)), 'b', slice(v.b, v.p + 1, size(v.b)), 'limit', v.limit)",
        f"u -> named_struct('n', cast({tail} as int), 'a', u.a, 'b', u.b, 'limit', u.limit)",
        "u -> named_struct('a', slice(u.a, 1, size(u.a) - u.n), 'b', slice(u.b, 1, size(u.b) - u.n), 'limit', u.limit)",
        f"u -> if(coalesce({few}, false), null, named_struct('a', array_join(u.a, ' '), 'b', array_join(u.b, ' '), 'limit', u.limit))",
        f"m -> m is null or ({within})",
    ]
    out = steps[0]
    for step in steps[1:]:
        out = f"transform({out}, {step})"
    both = f"named_struct('a', split({a}, ' '), 'b', split({b}, ' '), 'limit', {limit})"
    return F.expr(f"if(abs(char_length({a}) - char_length({b})) <= {limit}, {_once(both, 'v', f'coalesce({most} <= v.limit, false) or {out}[0]')}, false)")


def _mask(v: int) -> int:
    """The bits of a fingerprint that key ``v`` is made of, those whose vectors have an odd number of ones in common with v."""
    return sum(1 << i for i in range(WIDTH) if ((1 + i % ((2 << BITS) - 1)) & v).bit_count() % 2)


def _masks() -> list[int]:
    """The bits that each key of a fingerprint is made of; two fingerprints that differ in at most BITS bits agree in all bits of one.

    Every bit has a vector of BITS + 1 bits that is not zero, and every such vector v a key: of the bits whose vectors have an odd number
    of ones in common with v. The vectors of BITS bits leave one dimension at least, so that some v has an even number in common with each
    of them; its key has none of these bits.
    """
    return [_mask(v) for v in range(1, 2 << BITS)]


def _bundles(free: int) -> list[list[int]]:
    """The masks in bundles of up to 2 ** free that have bits in common, so that fingerprints alike in any key of a bundle are alike in these.

    The vectors that differ only in their last ``free`` bits share those bits that all of them have an odd number of ones in common with:
    ones whose own vectors end in ``free`` zeros. The vectors without any other bits are dealt out by fewer free bits.
    """
    size = 1 << free
    whole = [[_mask(v + k) for k in range(size)] for v in range(size, 2 << BITS, size)]
    return whole + [[_mask(v) for v in range(size >> k + 1, size >> k)] for k in range(free)]


def _lowest(mask: int, n: int) -> int:
    """The lowest ``n`` bits of a mask."""
    return sum(1 << i for i in [i for i in range(WIDTH) if mask >> i & 1][:n])


def _gathered(prints: DataFrame, n: int, bundles: list[list[int]]) -> DataFrame:
    """(m, fp): the different fingerprints (fp), ``n`` of them, whose keys by a mask m of the bundles others have too.

    Fingerprints come together by bits that a bundle shares, once for all of its masks. For each mask they are sorted, as numbers of which
    the upper bits are a hash of the key and the lower ones a place; keys that only seem equal do no harm.
    """
    shared = [_lowest(reduce(int.__and__, bundle), (n // GATHERED).bit_length()) for bundle in bundles]
    own = F.inline(F.array([F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for k, m in enumerate(shared)]))
    lists = prints.select("fp", own).groupBy("k", "bits").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    masks = F.array([F.array([F.lit(m).cast("long") for m in bundle]) for bundle in bundles])
    keyed = lists.select("fps", F.explode(F.get(masks, F.col("k"))).alias("m"))
    # What sorts and compares neighbours is not in lambda functions, so that it is compiled. No list is empty; a plain explode would first ask that and sort for it.
    order = keyed.select("m", "fps", F.sort_array(F.expr(f"transform(fps, (x, i) -> (xxhash64(x & m) & {-1 << _PLACE}L) | i)")).alias("order"))
    alike = [f"coalesce((s ^ get(order, i {way} 1)) & {-1 << _PLACE}L = 0, false)" for way in "+-"]
    places = order.select("m", "fps", "order", F.posexplode_outer("order").alias("i", "s")).where(" or ".join(alike))
    return places.select("m", F.expr(f"get(fps, cast(s & {(1 << _PLACE) - 1}L as int))").alias("fp"))


def _near(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    return F.bit_count(a("fp").bitwiseXOR(b("fp"))) <= BITS


class Places:
    """The place of a line, (id, pos), as one value in its order: a number if all places of ``lines`` have room in its 63 bits, which aggregates and joins take faster, else a struct."""

    def __init__(self, lines: DataFrame):
        ends = lines.agg(F.min("id"), F.max("id"), F.max("pos")).first()
        low, high, last = (x or 0 for x in ends)
        self.low, self.size = low, last + 1
        self.packed = (high - low + 1) * self.size < 1 << 63

    def of(self) -> Column:
        return (F.col("id") - F.lit(self.low).cast("long")) * F.lit(self.size).cast("long") + F.col("pos") if self.packed else F.struct("id", "pos")

    def id(self, name: str) -> Column:
        return F.expr(f"{name} div {self.size}L") + F.lit(self.low).cast("long") if self.packed else F.col(f"{name}.id")

    def pos(self, name: str) -> Column:
        return F.expr(f"cast({name} % {self.size}L as int)") if self.packed else F.col(f"{name}.pos")


def _links(exact: DataFrame, own: DataFrame, at: Places) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect what linked lines of ``exact`` (c, first, h, g, fp), each once, connect, and (c, first, h, g) of all lines that edges can have.

    Their texts are in ``own`` (id, text).
    """
    prints = exact.where("fp is not null").select("c", "fp", "first", "h", "g")
    different = Stored(prints.groupBy("fp").agg(F.count("*").alias("n")), "different").df
    n = different.count()
    # The bits that a bundle shares halve with each free bit.
    bundles = _bundles(next((free for free in range(FREE, 0, -1) if n >> (WIDTH >> free + 1) <= MOST_GATHERED), 0))
    runs = [bundles[k : k + RUN] for k in range(0, len(bundles), RUN)]
    with setting(exact.sparkSession, _FALLBACK, str(1 << 30)):
        gathered = reduce(DataFrame.unionByName, [Stored(_gathered(different.select("fp"), n, run), "keys").df for run in runs])
    keyed = gathered.select(F.xxhash64("m", F.col("fp").bitwiseAND(F.col("m"))).alias("key"), "fp")
    sums = [F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.expr("bit_xor(xxhash64(fp))").alias("x")]
    # Keys of the same fingerprints, which have the same sums, count once; keys of two that are too far apart don't.
    several = keyed.groupBy("key").agg(*sums).where((F.col("n") > 2) | ((F.col("n") == 2) & (F.bit_count(F.expr("a ^ b")) <= BITS)))
    several = Stored(several.groupBy("n", "a", "b", "x").agg(F.min("key").alias("key")), "several").df
    members = keyed.join(several.where("n > 2").select("key"), "key").unionByName(several.where("n = 2").select("key", F.explode(F.array("a", "b")).alias("fp")))
    # So do the lines of one fingerprint.
    own_key = different.where("n > 1").select(F.xxhash64("fp").alias("key"), "fp")
    shared = Stored(members.unionByName(own_key).join(prints, "fp").select("key", "c", "fp", "first", "h", "g"), "shared").df
    sizes = shared.groupBy("key").agg(F.count("*").alias("n"))
    pairs = groups.pairs_within(shared.select("key", "c", "fp").join(sizes.where(F.col("n") <= PAIRED), "key"), ["fp"], _near)
    pairs = Stored(pairs, "candidates").df
    many = shared.join(sizes.where(F.col("n") > PAIRED), "key").select("key", "c", "fp")

    # What is wanted of a line came with its keys, so that not all lines are looked through for it.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).union(many.select("c")).distinct()
    wanted = Stored(wanted.join(shared.drop("key").distinct().hint("merge"), "c"), "wanted").df
    few = wanted.count() <= HANDED
    places = wanted.select(at.id("first").alias("id"), F.struct(at.pos("first").alias("pos"), "c", "fp").alias("p")).groupBy("id").agg(F.collect_list("p").alias("at"))
    # Lines are taken out of a text before they part, so that none carries the whole text along.
    taken = _once("split(text, '\\n')", "t", "transform(at, p -> named_struct('c', p.c, 'fp', p.fp, 'line', t[p.pos]))")
    texts = own.join(places.hint("broadcast" if few else "merge"), "id").select(F.explode(F.expr(taken)).alias("p")).select("p.c", "p.fp", F.array_join(F.expr(_once(PLAIN.format("p.line"), "line", WORDS)), " ").alias("norm"))
    # Rows can repeat an id.
    texts = Stored(texts.groupBy("c").agg(F.first("fp").alias("fp"), F.first("norm").alias("norm")), "texts").df

    def verified(pairs: DataFrame, _: bool = False) -> DataFrame:
        both = pairs.join(texts.toDF("a", "fa", "na").hint("merge"), "a").join(texts.toDF("b", "fb", "nb").hint("merge"), "b")
        near = _near(lambda n: F.col("fa"), lambda n: F.col("fb"))
        return both.select("a", "b", F.lit(0.0).alias("j"), F.when(near, _similar("na", "nb")).otherwise(False).alias("linked"))

    found = groups.links_by_pivots(many, ["fp"], verified, _near, _near)
    ends = wanted.select("c", "first", "h", "g")
    if found is None:
        return verified(pairs).where("linked").select("a", "b"), ends
    in_many, roots = found
    # Pairs that links join already aren't compared.
    known = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    left = known.where("ra is null or rb is null or ra <> rb").select("a", "b")
    return verified(left).where("linked").select("a", "b").unionByName(in_many), ends


def dedup_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, text, n_lines, n_removed): each row of ``docs`` as a struct of its other columns, its text without repeated lines, and counts.

    As a struct the other columns can have any names. For the rest see ``dedup_lines``.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    lines = Stored(_lines(own), "lines").df
    at = Places(lines)
    place = at.of()
    # A line's number is a hash of its first place.
    exact = lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("fp").alias("fp"))
    exact = Stored(exact.withColumn("c", F.xxhash64("first")), "exact").df
    edges, ends = _links(exact, own, at)
    roots = connected(Stored(edges, "edges").df)
    ends = Stored(ends.join(roots.toDF("c", "root").hint("merge"), "c").select("c", "h", "g", "first", "root"), "ends").df
    grouped = ends.join(ends.groupBy("root").agg(F.min("first").alias("kept")), "root").select("h", "g", "kept")

    # Every occurrence of a line but the place kept goes.
    repeated = exact.where("n > 1").join(ends.select("c").hint("merge"), "c", "left_anti").select("h", "g", F.col("first").alias("kept"))
    firsts = grouped.unionByName(repeated)
    gone = lines.join(Stored(firsts, "firsts").df.hint("merge"), ["h", "g"]).where(place != F.col("kept")).groupBy("id").agg(F.collect_set("pos").alias("gone"))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != text_col.lower()])
    count = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(F.col(text_col), "\n")))
    found = docs.select(others.alias("row"), F.col(text_col).alias("text"), count.alias("n_lines"), F.col(id_col).cast("long").alias("key"))
    found = found.join(Stored(gone, "gone").df.hint("shuffle_hash"), F.col("key") == F.col("id"), "left")
    # Only texts that lose lines are split, each once.
    stay = "array_join(transform(array_except(sequence(0, size(t) - 1), gone), i -> get(t, i)), '\n')"
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr(_once("split(text, '\n')", "t", stay)))
    removed = F.when(F.col("text").isNull() | F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return found.select("row", left.alias("text"), "n_lines", removed.alias("n_removed"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and n_lines and n_removed for each row.

    The first occurrence, by (id, place), of each group of lines stays; blank lines and lines
    without words stay wherever they are. Null texts stay null, with no lines. All columns of
    ``docs`` are returned, of which ones named n_lines or n_removed are replaced. Rows of equal id
    are taken for one document: what is first in one of them is so in all. Rows without an id are
    left as they are. Lines of fewer than five words and 24 characters go with equal ones only.
    """
    found = dedup_rows(docs, id_col=id_col, text_col=text_col)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    own = [F.col("text").alias(c) if c.lower() == text_col.lower() else F.col("row").getField(c).alias(c) for c in names]
    return found.select(*own, "n_lines", "n_removed")
