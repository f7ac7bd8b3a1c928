"""From raw documents to a training mix, in stages that are each written and read again.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns the
columns of ``documents``; the last returns the mix: which document, in which copy, in which block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopscope.llm import contamination, langid, lines, mixing, simhash
from loopscope.llm.tables import Stored, scratch, table

#: Documents whose language matches its nearest profile less than this are rejected, in any case.
LEAST_SCORE = 0.05
#: So are those that match it less than this share of what the least sure hundredth of held-out documents do.
SHARE, SURE = 0.55, 0.01
#: Parts that a range of scores is cut into, and scores that are sorted in one place, at most.
PARTS, SORTED = 1000, 100_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; others (null text, no letters, like no known profile) go. A missing ``lang`` is filled in.

    Rows are judged one by one: null or repeated ids and repeated rows play no part. Extra columns pass through, whatever their names.
    """
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    profiles = langid.fit(docs, part != 1, rows=None)
    # Columns go by place, so that none clashes with the prediction's.
    own = [f"c{k}" for k in range(len(docs.columns))]
    found = langid.predict(docs, profiles, keep=tuple(docs.columns)).toDF(*own, "predicted", "sure")
    kept = found.where((F.col("predicted") != langid.UNKNOWN) & (F.col("sure") >= least_score(docs.where(part == 1), profiles)))
    filled = [F.coalesce(c, "predicted") if name.lower() == "lang" else F.col(c) for name, c in zip(docs.columns, own, strict=True)]
    return kept.select(*[x.alias(name) for name, x in zip(docs.columns, filled, strict=True)])


def least_score(held_out: DataFrame, profiles: langid.Profiles) -> float:
    """The score that documents need, from those of all held-out ones in the language they are said to have."""
    known = held_out.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    right = langid.predict(known, profiles, keep=("lang",)).where("lang = lang_pred").select("score")
    return max(LEAST_SCORE, SHARE * (_quantile(Stored(right, "scores").df, SURE) or 0.0))


def _quantile(scores: DataFrame, share: float) -> float | None:
    """The exact quantile of ``score``, all from 0 to 1, between ranks in proportion; None without scores."""
    n = scores.count()
    if not n:
        return None
    at = share * (n - 1)
    low = _ranked(scores, int(at), n)
    high = _ranked(scores, min(int(at) + 1, n - 1), n)
    return low + (at - int(at)) * (high - low)


def _ranked(scores: DataFrame, rank: int, n: int) -> float:
    """The score of ``rank``, from 0; the range that holds it is cut until few scores, or equal ones, are left."""
    while n > SORTED:
        ends = scores.agg(F.min("score"), F.max("score")).first()
        low, high = ends[0], ends[1]
        if low == high:
            return low
        part = F.least(F.floor((F.col("score") - low) / (high - low) * PARTS), F.lit(PARTS - 1))
        for r in sorted(scores.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"]):
            if rank < r["count"]:
                scores, n = scores.where(part == r["part"]), r["count"]
                break
            rank -= r["count"]
    return scores.agg(F.sort_array(F.collect_list("score"))[rank].alias("s")).first()["s"]


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier place has; those that lose lines and have no words left go.

    Null texts and rows without an id stay as they are; rows of one id are one document. Extra columns pass through; n_chars is counted anew.
    """
    left = lines.dedup_rows(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x00-\x20]"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[new.get(c.lower(), F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingle similarity of 0.8 at least), that of the smallest id.

    Rows without an id stay; rows of one id are one document, and stay or go together. Null texts and texts without words are
    copies of each other. Extra columns pass through, whatever their names.
    """
    groups = simhash.similar_documents(docs)
    gone = Stored(groups.where("root <> node").select("node").distinct(), "copies").df
    return _without(docs, gone)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone``; by place, so that no name clashes."""
    own = [f"c{k}" for k in range(len(docs.columns))]
    at = own[[c.lower() for c in docs.columns].index("doc_id")]
    return docs.toDF(*own).join(gone.toDF("gone"), F.col(at) == F.col("gone"), "left_anti").toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Each row is judged by its own text, whatever its id, null and repeated ones too; null texts stay. Extra columns pass through.
    """
    return contamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, copy, block, n_tokens, weight.

    Null texts and texts without words are not in it; a null source is a source of its own; repeated rows each take part. Extra columns are not used.
    """
    return mixing.mix(docs, entropy=0.95)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing_to_weights),
]

#: Language ID and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. What a stage stored for itself, and its input, go when it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as keep:
            done = keep(Stored(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            before.drop()
        docs, before = done.df, done
    return docs
