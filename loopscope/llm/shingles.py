"""Exact similarity of sets of word shingles.

Two sets are linked if their Jaccard similarity is at least 4/5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopscope.llm import groups

#: Words in a shingle, and similarity of linked sets, as a fraction.
SHINGLE, OVER, UNDER = 5, 4, 5
#: Fixed value: the hash's seed.
SEED = 42


def word_runs(words: list[bytes], shingle: int) -> np.ndarray:
    """The hash of each run of ``shingle`` words, of all of them if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, ends = np.concatenate([[0], ends[:-1] + 1])[: len(words) - n + 1], ends[n - 1 :]
    digest, found = xxhash.xxh64_intdigest, np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), 8192):
        first, last = starts[at : at + 8192].tolist(), ends[at : at + 8192].tolist()
        found[at : at + 8192] = [digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)]
    return found


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, each once, in ascending order; a text of fewer words is one shingle."""
    return np.unique(word_runs(text.lower().split(), shingle).view(np.int64))


def set_hash(hashes: np.ndarray) -> int:
    """The hash by which a set is known, as a signed number."""
    found = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return found - (1 << 64) if found >> 63 else found


def whole_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(c, n, s): the shingle sets of (c, text), without texts whose set has another hash than c."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for at in range(0, all_.num_rows, 500):
                batch = all_.slice(at, 500)
                found = [(c, s) for c, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if set_hash(s := shingle_set(t.as_py() or b"", shingle)) == c]
                offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *(s for _, s in found)])))
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), lists], ["c", "n", "s"])

    return docs.mapInArrow(make, "c long, n long, s array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b), each once, with the similarity j of their sets and whether it is enough."""
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("t"))
    return both.select("a", "b", (F.col("i") / (F.col("t") - F.col("i"))).alias("j"), (UNDER * F.col("i") >= OVER * (F.col("t") - F.col("i"))).alias("linked"))


def possible(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether two sets can be similar by their sizes."""
    return UNDER * F.least(a("n"), b("n")) >= OVER * F.greatest(a("n"), b("n"))


def reach(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether a set not linked to a pivot can be similar to one that is.

    One minus the similarity is a distance, so the two are no nearer than their distances to the pivot differ.
    """
    return possible(a, b) & (a("j") >= (2 * OVER - UNDER) / UNDER - 1e-9) & (b("j") <= a("j") + (UNDER - OVER) / UNDER + 1e-9)


def links(keyed: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Edges (a, b) that connect what similar sets within each key of (key, c, n) connect, however many have the key."""
    found = groups.links_by_pivots(keyed, ["n"], lambda pairs, _: verified(pairs, sets), possible, reach)
    return None if found is None else found[0]
