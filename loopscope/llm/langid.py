"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent character n-grams, most frequent first. A text is
given the language whose profile is nearest by the out-of-place distance: for each n-gram of the
text's profile the difference of its two ranks, or the profile's length where the language lacks it.

N-grams are of lower-cased letters; every run of other characters is one word break.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: N-gram lengths and profile length.
LENGTHS, PROFILE = (1, 2, 3, 4), 400
#: Rows of each language that profiles are fitted on, at most (by the ids' hashes).
FIT_ROWS = 5_000
UNKNOWN = "und"
#: 15 bits a character: below the private use area every letter has a code of its own, modulo this.
_CODES = 1 << 15


def _letter_table() -> np.ndarray:
    """For each code point of the first plane, 1 + its code if it is a letter, else 0 (a break)."""
    return np.array([1 + k % (_CODES - 1) if chr(k).isalpha() else 0 for k in range(1 << 16)], np.int64)


class _Grams:
    """N-grams of texts, as numbers: the length in the top bits, 15 bits a character below."""

    def __init__(self) -> None:
        self.letters = _letter_table()

    def has_letter(self, text: str | None) -> bool:
        return text is not None and any(map(str.isalpha, text))

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of a text in ascending order and how often each occurs."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = self.letters[np.where(points < len(self.letters), points, 0)]
        if len(points) and points.max() >= len(self.letters):
            for k in np.flatnonzero(points >= len(self.letters)):
                codes[k] = 1 + int(points[k]) % (_CODES - 1) if chr(points[k]).isalpha() else 0
        codes = np.concatenate([[0], codes, [0]])
        codes = codes[1:][(codes[1:] != 0) | (codes[:-1] != 0)]
        codes = np.concatenate([[0], codes])
        parts, rolled = [], np.zeros(len(codes), np.int64)
        for n in range(1, max(LENGTHS) + 1):
            rolled = (rolled[:-1] << 15 if n > 1 else rolled) | codes[n - 1 :]
            if n in LENGTHS:
                parts.append((rolled if n > 1 else rolled[rolled > 0]) | n << 60)
        grams = np.sort(np.concatenate(parts))
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        return grams[starts], np.diff(np.append(starts, len(grams)))

    def profile(self, text: str) -> np.ndarray:
        """The most frequent n-grams, ties by number."""
        grams, counts = self.counts(text)
        if len(grams) > PROFILE:
            least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
            keep = counts >= least
            grams, counts = grams[keep], counts[keep]
        return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


class Profiles:
    """Fitted profiles; small: PROFILE numbers a language."""

    def __init__(self, ranked: dict[str, np.ndarray]):
        self.languages = sorted(ranked)
        every = np.unique(np.concatenate([ranked[x] for x in self.languages])) if ranked else np.zeros(0, np.int64)
        #: Ranks of every known n-gram in each language, PROFILE where it lacks it.
        self.known, self.ranks = every, np.full((len(every) + 1, len(self.languages)), PROFILE, np.int64)
        for k, x in enumerate(self.languages):
            self.ranks[np.searchsorted(every, ranked[x]), k] = np.arange(len(ranked[x]))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, profile)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == profile, at, len(self.known))
        ranks = self.ranks[at]
        return np.where(ranks < PROFILE, np.abs(ranks - np.arange(len(profile))[:, None]), PROFILE).sum(0)


def _scored(distances: np.ndarray, length: int) -> tuple[int, float]:
    """The nearest language and how sure it is: its share of profile matched, 1 if in place all over."""
    best = int(np.argmin(distances))
    return best, float(1 - distances[best] / (length * PROFILE))


def fit(docs: DataFrame, train: F.Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int | None = FIT_ROWS) -> Profiles:
    """Profiles of each language from the rows that ``train`` holds for and that have a text and a language.

    Of each language about ``rows`` rows are used, those with the smallest hashes of their ids (all
    of them if there are fewer, or ``rows`` is None); n-grams are counted over their whole texts.
    """
    own = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("draw")
    )
    if rows is not None:
        sizes = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            return Profiles({})
        share = reduce(add, (F.when(F.col("lang") == x, F.lit(min(1.0, rows / n))).otherwise(0.0) for x, n in sizes.items()))
        own = own.where(F.col("draw") < share * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of each language's n-grams in a partition."""
        grams, held = _Grams(), {}
        for batch in batches:
            for lang, text in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                held.setdefault(lang, []).append(grams.counts(text))
                if len(held[lang]) >= 64:
                    held[lang] = [_merged(held[lang])]
        for lang, parts in held.items():
            found, counts = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(counts)], ["lang", "gram", "n"])

    counted = own.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top: dict[str, list[tuple[int, int]]] = {}
    for r in counted.withColumn("rank", best).where(F.col("rank") <= PROFILE).collect():
        top.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return Profiles({x: np.array([g for _, g in sorted(found)], np.int64) for x, found in top.items()})


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(where, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)


def predict(docs: DataFrame, profiles: Profiles, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, then ``lang_pred`` and ``score`` (0 to 1, higher: surer) of each row.

    ``und`` with score 0 where the text is null or has no letter, or no language was learnt. Texts
    are read whole, at any length; ties go to the language that sorts first; repeated rows give a
    row each. Columns outside ``keep`` are not returned; those within it can have any names, so
    that the two added are the last two, whatever else is called like them.
    """
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    kept = rows.drop("text").schema
    ids = kept.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                langs, scores = [], []
                for text in batch.column("text").to_pylist():
                    if not profiles.languages or not grams.has_letter(text):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    profile = grams.profile(text)
                    best, sure = _scored(profiles.distances(profile), len(profile))
                    langs.append(profiles.languages[best])
                    scores.append(sure)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*ids, "lang_pred", "score"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])
    return rows.mapInArrow(score, schema).toDF(*keep, "lang_pred", "score")
