"""Benchmark items contained in documents, by size-partitioned MinHash containment search.

An item is contained in a document if at least ``threshold`` of its distinct word shingles are
among the document's. If it has s shingles, any s - ceil(threshold * s) + 1 of them then hold one of
the document's; the search takes those with the smallest hashes, the item's bottom-k MinHash sketch.
Items are partitioned by size (powers of two), each partition with its sketch length, and stated
items go to the documents in blocks of bounded size. A long document is not sketched, since a sketch
of it would lose short items: its shingles are probed for the sketches' hashes, so no contained item
is missed. Candidates are verified by the exact shingles. An item of fewer than five words has one
shingle, all its words in a row.

Words are runs of bytes other than ASCII white space, punctuation and control characters, with A-Z
in lower case.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a shingle, the share of an item's shingles that makes it contained.
SHINGLE, THRESHOLD = 5, 0.8
#: Bytes of items in one block; what is handed to the workers at once never exceeds this and one item.
BLOCK_BYTES = 16_000_000

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 32 or 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def shingles_of(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    """Each run of ``n`` words once; none if there are fewer."""
    return {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def _shingle_hashes(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``n`` words; the words' own hashes hold within this process only."""
    own = _word_hashes(words)
    if len(words) < n:
        return own[:0]
    found = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        found = (found * _MIX) ^ own[k : len(own) - n + 1 + k]
        found ^= found >> np.uint64(29)
    return found * _MIX


def sketch_length(size: int, threshold: float = THRESHOLD) -> int:
    """Hashes that an item of ``size`` shingles needs so that no document containing it escapes."""
    return size - math.ceil(threshold * size - 1e-9) + 1


class _Block:
    """The items of one block whose shingles have ``n`` words, with their sketches, by size partition."""

    def __init__(self, items: list[tuple[int, list[bytes]]], threshold: float, n: int):
        self.threshold, self.n, self.items, hashes, owners = threshold, n, [], [], []
        for item_id, words in items:
            own = shingles_of(words, n)
            size = len(own)
            # One length for a partition: that of its largest size, which serves the smaller ones too.
            length = min(size, sketch_length((1 << size.bit_length()) - 1, threshold))
            sketch = np.unique(_shingle_hashes(words, n))[:length]
            hashes.append(sketch)
            owners.append(np.full(len(sketch), len(self.items)))
            self.items.append((item_id, own))
        every, owner = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, owners))
        order = np.argsort(every, kind="stable")
        self.hashes, self.owners = every[order], owner[order].astype(np.int64)
        # A bit for the top 20 bits of each hash, so that most shingles need no search.
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def found_in(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(item, its shingles found, its shingles) of every item contained in a text of these words."""
        hashes = _shingle_hashes(words, self.n)
        hashes = hashes[self.seen[(hashes >> np.uint64(44)).astype(np.int64)]]
        if not len(hashes):
            return []
        hashes = np.unique(hashes)
        first, last = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        candidates = sorted({int(o) for a, b in zip(first, last, strict=True) if a < b for o in self.owners[a:b]})
        if not candidates:
            return []
        own, found = shingles_of(words, self.n), []
        for k in candidates:
            item_id, shingles = self.items[k]
            shared = len(shingles & own)
            if shared >= self.threshold * len(shingles) - 1e-9:
                found.append((item_id, shared, len(shingles)))
        return found


def _found(items: list[tuple[int, bytes]], threshold: float) -> Callable[[bytes], list[tuple[int, int, int]]]:
    """A function that gives the items contained in a text."""
    by_length: dict[int, list[tuple[int, list[bytes]]]] = {}
    for item_id, text in items:
        words = words_of(text)
        if words:
            by_length.setdefault(min(SHINGLE, len(words)), []).append((item_id, words))
    blocks = [_Block(some, threshold, n) for n, some in sorted(by_length.items())]

    def found(text: bytes) -> list[tuple[int, int, int]]:
        words = words_of(text)
        return [hit for block in blocks for hit in block.found_in(words)]

    return found


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The items, each once, dealt by hash to blocks of bounded size."""
    own = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("text")).where("item is not null and text is not null").distinct()
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    return [own.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) for b in range(n)]


def _held(block: DataFrame):
    """One block, handed to the workers; no more than ``BLOCK_BYTES`` on average, and one item."""
    return block.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["text"])) for r in block.collect()])


def contained_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row (id, item, n_shared, n_shingles, containment) for each item contained in each row of ``docs``.

    Items of fewer than five words are found as one run of words, items without words never; null
    texts, of either side, hold nothing; long texts are searched whole. A repeated item id with the
    same text counts once, a repeated document row gives its rows again. Other columns are not used.
    Documents are read once for each block of items.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    parts = [_search(rows, block, threshold) for block in _blocks(items, item_col, item_text_col, block_bytes)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def _search(rows: DataFrame, block: DataFrame, threshold: float) -> DataFrame:
    held = _held(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = _found(held.value, threshold)
        for batch in batches:
            found = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if text.is_valid for hit in within(text.as_py())]
            columns = zip(*found, strict=True) if found else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "item", "n_shared", "n_shingles"])

    return rows.mapInArrow(search, "id long, item long, n_shared long, n_shingles long")


def clean_rows(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns, whatever these are called.

    Each row is judged by its own text: ids, null or repeated, play no part. Null texts stay.
    """
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def kept(held, threshold):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            within = _found(held.value, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not (text.is_valid and within(text.as_py().encode())) for text in batch.column(at)], pa.bool_()))

        return keep

    for block in _blocks(items, item_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(kept(_held(block), threshold), docs.schema)
    return docs


#: The same in DuckDB's SQL: every shingle of every document joined with the items'.
ORACLE_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark WHERE text IS NOT NULL
), shingles AS (
  SELECT DISTINCT kind, id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k+m-1], ' '))) AS s
  FROM words, (SELECT DISTINCT least(5, len(w)) AS m FROM words WHERE kind = 'i' AND len(w) > 0) WHERE len(w) >= m AND (kind = 'd' OR m = least(5, len(w)))
), items AS (
  SELECT id, m, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'i'
)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, i.n AS n_shingles, count(*) / i.n AS containment
FROM shingles d JOIN items i USING (m, s) WHERE d.kind = 'd'
GROUP BY d.id, i.id, i.n HAVING count(*) >= 0.8 * i.n - 1e-9
"""
