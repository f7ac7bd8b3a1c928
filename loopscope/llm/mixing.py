"""Mixing sources to target weights: temperature, then budgeted block permutations.

The weight of a source is its share of tokens raised to an exponent, normalised. The exponent is
bisected: the largest share's exponent 1 is the corpus as it is, 0 is equal weights. It meets either
a target entropy (as a share of the largest possible) or the largest number of times that any
source may be repeated within the budget, or, where both are given, the one that asks for less.

A source's documents are dealt to blocks by hash; in every pass over the source, blocks come in an
order of their own, and documents within a block too. Whole passes are taken while the source's
budget lasts, then whole blocks of the next pass, and of the block where the budget ends its first
documents. Blocks of a source, whose number follows its tokens, are summed in two steps, along
groups of blocks and within one, each of about the square root of their number; documents are summed along a
block, whose size is bounded. So one large source needs no long window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopscope.llm.tables import Stored

#: Times that a source is repeated at most, unless another limit is given, however little text it has.
REPEATS = 16.0
#: Passes that are made at once for each row; a row's passes are made in runs of so many.
PASSES = 1_000
#: Tokens that a block holds on average.
BLOCK_TOKENS = 250_000
#: Exponents tried at once in each step of the bisection, and its steps.
TRIED, NARROWED = 33, 8
#: Decimals that the exponent and weights are rounded to, so that sums in another order agree.
DECIMALS = 9
SEED = "loopscope"


def n_tokens(text: Column) -> Column:
    """Words of a text: runs of other than ASCII white space. A null text has none."""
    flat = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.coalesce(F.when(flat == "", 0).otherwise(F.size(F.split(flat, " +"))), F.lit(0)).cast("long")


def _draw(*parts: Column | str) -> Column:
    """A number from 0 up to 2^32 that only the parts decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def exponent(totals: DataFrame, *, entropy: float | None = None, repeats: float | None = None, budget: float | None = None) -> float:
    """The largest exponent from 0 to 1 whose weights have at least ``entropy`` times the largest
    possible entropy, or the smallest that repeats no source over ``repeats`` times for ``budget`` tokens.

    ``totals`` holds (source, tokens), tokens over 0. If no exponent does, the nearest end is
    given. One row of figures comes to the driver for each step, however many sources there are.
    With both, the larger of the two exponents: repeats are bounded first.
    """
    if entropy is not None and repeats is not None:
        return max(exponent(totals, entropy=entropy, budget=budget), exponent(totals, repeats=repeats, budget=budget))
    size = totals.agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).first()
    if not size["n"]:
        return 1.0
    budget = size["t"] if budget is None else budget
    share = F.col("tokens") / F.lit(float(size["t"]))
    low, high = 0.0, 1.0
    for _ in range(NARROWED):
        tried = [low + (high - low) * k / (TRIED - 1) for k in range(TRIED)]
        powers = totals.agg(*[F.sum(F.pow(share, F.lit(a))).alias(f"z{k}") for k, a in enumerate(tried)]).first()
        weight = [F.pow(share, F.lit(a)) / F.lit(powers[f"z{k}"]) for k, a in enumerate(tried)]
        if entropy is not None:
            # Entropy falls as the exponent grows.
            got = totals.agg(*[F.sum(-w * F.log(w)).alias(f"v{k}") for k, w in enumerate(weight)]).first()
            good = [got[f"v{k}"] >= entropy * math.log(size["n"]) - 1e-12 for k in range(TRIED)]
            if good[-1]:
                return round(high, DECIMALS)
            if not good[0]:
                return round(low, DECIMALS)
            k = max(i for i, ok in enumerate(good) if ok)
            low, high = tried[k], tried[k + 1]
        else:
            # The most repeated source is repeated less as the exponent grows.
            got = totals.agg(*[F.max(w * F.lit(float(budget)) / F.col("tokens")).alias(f"v{k}") for k, w in enumerate(weight)]).first()
            good = [got[f"v{k}"] <= repeats + 1e-12 for k in range(TRIED)]
            if good[0]:
                return round(low, DECIMALS)
            if not good[-1]:
                return round(high, DECIMALS)
            k = min(i for i, ok in enumerate(good) if ok)
            low, high = tried[k - 1], tried[k]
    return round(low if entropy is not None else high, DECIMALS)


def weights(totals: DataFrame, alpha: float, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, target): the tokens that each source gets, rounded to whole ones."""
    size = totals.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    share = F.pow(F.col("tokens") / F.lit(float(size)), F.lit(alpha))
    z = totals.agg(F.sum(share).alias("z")).first()["z"] or 1.0
    weight = F.round(share / F.lit(z), DECIMALS)
    return totals.select("source", "tokens", weight.alias("weight"), F.round(weight * F.lit(float(size if budget is None else budget))).cast("long").alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float | None = 0.95, repeats: float | None = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The rows of a training mix: (id, source, copy, block, n_tokens, weight).

    ``entropy`` is met as far as no source is repeated over ``repeats`` times (None: however often).
    ``copy`` counts a row's passes from 0. ``budget`` is in tokens, the corpus's own if not given.
    A null source is a source of its own. Rows without tokens are never taken, since no budget
    buys them; a source without tokens has no weight. Repeated rows each take part, with the order
    that their equal hashes give; which of equal rows falls to the last tokens makes no difference.
    Columns other than these three are not used.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_tokens(F.col(text_col)).alias("n_tokens")).where("n_tokens > 0")
    own = Stored(rows, "tokens")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    totals = Stored(own.df.groupBy(key.alias("source")).agg(F.sum("n_tokens").alias("tokens")), "totals").df
    parts = weights(totals, exponent(totals, entropy=entropy, repeats=repeats, budget=budget), budget).where("target > 0")
    parts = Stored(parts.withColumn("n_blocks", F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long")), "weights").df
    dealt = own.df.select("id", F.col("source").alias("name"), key.alias("source"), "n_tokens")
    dealt = dealt.join(parts, "source").withColumn("block", F.pmod(_draw(F.lit("block"), F.coalesce(F.col("id").cast("string"), F.lit("-"))), F.col("n_blocks")))

    # Blocks in each pass's order; a whole pass needs no order to be taken whole.
    sizes = dealt.groupBy("source", "block", "n_blocks", "target", "tokens").agg(F.sum("n_tokens").alias("block_tokens"))
    whole = F.expr("target div tokens")
    last = sizes.withColumn("copy", whole).withColumn("left", F.col("target") - whole * F.col("tokens"))
    last = last.withColumn("place", _draw(F.lit("order"), F.col("copy").cast("string"), F.col("source"), F.col("block").cast("string")))
    # Places run up to 2^32, so equal stretches of them hold about as many blocks each.
    last = Stored(last.withColumn("part", F.floor(F.col("place") * F.ceil(F.sqrt("n_blocks")) / float(1 << 32)).cast("long")), "block-sizes").df
    parts_before = F.sum("part_tokens").over(Window.partitionBy("source").orderBy("part")) - F.col("part_tokens")
    sums = last.groupBy("source", "part").agg(F.sum("block_tokens").alias("part_tokens")).select("source", "part", parts_before.alias("ahead"))
    before = F.sum("block_tokens").over(Window.partitionBy("source", "part").orderBy("place", "block")) - F.col("block_tokens") + F.col("ahead")
    blocks = Stored(last.join(sums, ["source", "part"]).withColumn("room", F.greatest(F.col("left") - before, F.lit(0))).select(F.col("source").alias("s"), F.col("block").alias("b"), "block_tokens", "room"), "blocks").df

    runs = dealt.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(target div tokens - 1) div {PASSES}")))).where(whole > 0)
    passes = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * PASSES, F.least(F.col("run") * PASSES + PASSES, whole) - 1)))
    full = passes.select("id", "name", "copy", "block", "n_tokens", "weight")
    final = dealt.withColumn("copy", whole).join(blocks.where("room > 0"), (F.col("source") == F.col("s")) & (F.col("block") == F.col("b")))
    order = _draw(F.lit("row"), F.col("copy").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("-")))
    inside = Window.partitionBy("source", "block").orderBy(order, "id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A block with room for all its tokens is taken whole; only the others are summed along.
    cut = final.where("room < block_tokens").withColumn("sum", F.sum("n_tokens").over(inside)).where("sum <= room")
    taken = full.unionByName(final.where("room >= block_tokens").select(full.columns)).unionByName(cut.select(full.columns))
    return taken.select(F.col("id").alias(id_col), F.col("name").alias(source_col), "copy", "block", "n_tokens", "weight")


#: The same in DuckDB's SQL, for an entropy of 0.95 times the largest possible, the usual limit of repeats and the corpus's own budget.
ORACLE_SQL = f"""
WITH RECURSIVE own AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS k, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), totals AS (
  SELECT k, sum(n_tokens) AS tokens FROM own WHERE n_tokens > 0 GROUP BY k
), shares AS (
  SELECT k, CAST(tokens AS BIGINT) AS tokens, tokens / (SELECT CAST(sum(tokens) AS DOUBLE) FROM totals) AS share FROM totals
), search AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN e >= 0.95 * m - 1e-12 THEN (low + high) / 2 ELSE low END, CASE WHEN e >= 0.95 * m - 1e-12 THEN high ELSE (low + high) / 2 END
  FROM (SELECT i, low, high, (SELECT ln(sum(pow(share, (low + high) / 2))) - sum(pow(share, (low + high) / 2) * ln(pow(share, (low + high) / 2))) / sum(pow(share, (low + high) / 2)) FROM shares) AS e, (SELECT ln(count(*)) FROM shares) AS m FROM search WHERE i < 50)
), bounded AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN most <= {REPEATS} + 1e-12 THEN low ELSE (low + high) / 2 END, CASE WHEN most <= {REPEATS} + 1e-12 THEN (low + high) / 2 ELSE high END
  FROM (SELECT i, low, high, (SELECT max(pow(share, (low + high) / 2) / share) / sum(pow(share, (low + high) / 2)) FROM shares) AS most FROM bounded WHERE i < 50)
), limited AS (
  SELECT CASE WHEN (SELECT max(1 / share) / count(*) FROM shares) <= {REPEATS} + 1e-12 THEN 0.0 ELSE round(high, {DECIMALS}) END AS b FROM bounded ORDER BY i DESC LIMIT 1
), wanted AS (
  SELECT CASE WHEN (SELECT ln(sum(share)) - sum(share * ln(share)) / sum(share) FROM shares) >= 0.95 * (SELECT ln(count(*)) FROM shares) - 1e-12 THEN 1.0 ELSE round(low, {DECIMALS}) END AS a FROM search ORDER BY i DESC LIMIT 1
), alpha AS (
  SELECT greatest(a, b) AS a FROM wanted, limited
), parts AS (
  SELECT k, tokens, weight, CAST(round(weight * (SELECT sum(tokens) FROM shares)) AS BIGINT) AS target, CAST(ceil(tokens / {BLOCK_TOKENS}) AS BIGINT) AS n_blocks
  FROM (SELECT k, tokens, round(pow(share, a) / sum(pow(share, a)) OVER (), {DECIMALS}) AS weight FROM shares, alpha)
), dealt AS (
  SELECT doc_id, source, n_tokens, p.*, CAST('0x' || substr(md5('{SEED}:block:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 8) AS BIGINT) % n_blocks AS block, target // tokens AS passes
  FROM own JOIN parts p USING (k) WHERE n_tokens > 0 AND target > 0
), blocks AS (
  SELECT k, block, block_tokens, greatest(rest - (sum(block_tokens) OVER (PARTITION BY k ORDER BY CAST('0x' || substr(md5('{SEED}:order:' || passes || ':' || k || ':' || block), 1, 8) AS BIGINT), block) - block_tokens), 0) AS room
  FROM (SELECT k, block, passes, target - passes * tokens AS rest, sum(n_tokens) AS block_tokens FROM dealt GROUP BY ALL)
), final AS (
  SELECT d.*, room, block_tokens, sum(n_tokens) OVER (PARTITION BY k, block ORDER BY CAST('0x' || substr(md5('{SEED}:row:' || passes || ':' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 8) AS BIGINT), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS s
  FROM dealt d JOIN blocks USING (k, block)
)
SELECT doc_id, source, copy, block, n_tokens, weight FROM (SELECT *, unnest(range(passes)) AS copy FROM dealt)
UNION ALL
SELECT doc_id, source, passes AS copy, block, n_tokens, weight FROM final WHERE s <= room
"""
