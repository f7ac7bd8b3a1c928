"""Passages repeated across documents, by FM-indexes over shards of the corpus's own stretches.

A window is a run of 13 words. Each window has an anchor: the 5-word run in it with the smallest
hash (the first of equals). Equal windows have equal anchors, so the corpus is dealt out by anchor:
a stretch, all windows around one occurrence of an anchor, goes to the shard of its anchor's hash,
and a window's copies are all in one shard. Only anchors that occur in two documents matter, and
stretches are sent once for each different text, with the smallest document that has it. An anchor
that very many stretches have is cut into its single windows, which go by their own hashes.

Each shard indexes its stretches: a suffix array cut off at the window's length, the BWT, and over it
a wavelet matrix of packed bits with counts for each 64. The stretches are then streamed through the
index by backward search, word by word; a search ends when just one place is left or the window's
length is reached, which is the matching statistic cut off there. Intervals that reach it give the
smallest document that has the window.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopscope.llm.tables import Stored

#: Words in a window and in an anchor.
WINDOW, ANCHOR = 13, 5
#: Stretches of one anchor from which it is cut into windows; stretches in a shard, on average.
CUT, SHARD = 1000, 20_000
#: Words whose hashes a worker keeps.
KEPT_WORDS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd bases of the two hashes of a stretch.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    found = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        found = _mixed(found + hashes[k : len(hashes) - n + 1 + k])
    return found


def stretches(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of each stretch of one document's word hashes."""
    return stretches_of([hashes], window, anchor)[:3]


def stretches_of(lists: list[np.ndarray], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of several documents at once, one after another, and where those of each begin and end."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ends, doc = np.cumsum(sizes), np.repeat(np.arange(len(lists)), sizes)
    # Windows that reach into the next document are none.
    windows = np.flatnonzero(np.arange(len(doc)) + window <= ends[doc])
    if not len(windows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(lists) + 1, np.int64)
    grams = _runs(np.concatenate(lists), anchor)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1).argmin(1)[windows] + windows
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    owners = doc[windows[first]]
    return grams[at[first]], windows[first] - (ends - sizes)[owners], np.diff(np.append(first, len(at))), np.searchsorted(owners, np.arange(len(lists) + 1))


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are among the values."""
    if not len(values):
        return np.zeros(len(x), bool)
    values = np.sort(values)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _sums(hashes: np.ndarray, base: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the ``size`` words from each ``start``: differences of running polynomial sums."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(hashes) + 1, base, np.uint64))
        back = np.cumprod(np.full(len(hashes) + 1, pow(base, -1, 1 << 64), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1])])
        return _mixed((sums[start + size] - sums[start]) * back[start] + size.astype(np.uint64))


def _hashed(words: list[bytes], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one packed bit vector a level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.words, self.counts, self.zeros = len(symbols), levels, [], [], []
        for level in range(levels - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(len(bits) - int(bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[level][word] + np.bitwise_count(below)

    def spans(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``lo`` and before ``hi``."""
        start = np.zeros(len(symbol), np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            s, a, b = (self._ones(k, x) for x in (start, lo, hi))
            z = self.zeros[k]
            start, lo, hi = (np.where(one, z + r, x - r) for r, x in ((s, start), (a, lo), (b, hi)))
        return lo - start, hi - start


class FMIndex:
    """Backward search over sequences of symbols, each with the document that owns it."""

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, depth: int):
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.alphabet, inverse = np.unique(np.concatenate(sequences), return_inverse=True)
        # Symbol 0 ends each sequence.
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(lengths.sum()) + len(sequences), np.int64)
        text[np.delete(np.arange(len(text)), ends)] = inverse + 1
        self.text, self.starts = text, np.concatenate([[0], ends[:-1] + 1])
        rank, step = text.copy(), 1
        while step < depth:
            # What follows an end never counts as equal to anything but another end.
            after = np.zeros_like(rank)
            after[:-step] = rank[step:]
            rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1]
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.owners = np.repeat(owners, lengths + 1)[order]
        counts = np.bincount(text, minlength=len(self.alphabet) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(len(self.alphabet)).bit_length()))

    def smallest_owners(self, place: np.ndarray, length: int) -> np.ndarray:
        """The smallest owner of each run of ``length`` symbols that starts at the places of the text."""
        found = np.full(len(place), np.iinfo(np.int64).max)
        open_, lo, hi = np.arange(len(place)), np.zeros(len(place), np.int64), np.full(len(place), len(self.text))
        for k in range(length - 1, -1, -1):
            symbol = self.text[place[open_] + k]
            a, b = self.bwt.spans(symbol, lo, hi)
            lo, hi = self.before[symbol] + a, self.before[symbol] + b
            # One place left is the window's own, and then it is nowhere else.
            more = hi - lo > 1
            open_, lo, hi = open_[more], lo[more], hi[more]
            if not len(open_):
                return found
        ranges, which = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
        flat = np.append(self.owners, np.iinfo(np.int64).max)
        smallest = np.minimum.reduceat(flat, ranges.ravel())[::2]
        found[open_] = smallest[which.ravel()]
        return found


def _anchors(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, doc): the anchors of each document, each once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                anchors, _, _, bounds = stretches_of([_hashed(x.as_py().split(), known) for x in batch.column(1)], window, anchor)
                places = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                order = np.lexsort((anchors, places))
                anchors, places = anchors[order], places[order]
                once = np.ones(len(anchors), bool)
                once[1:] = (anchors[1:] != anchors[:-1]) | (places[1:] != places[:-1])
                docs = batch.column(0).to_numpy()[places[once]]
                yield pa.RecordBatch.from_arrays([pa.array(anchors[once].view(np.int64)), pa.array(docs)], ["anchor", "doc"])

    return rows.select("doc", "text").mapInArrow(make, "anchor long, doc long")


def _stretches(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """The stretches at the anchors listed in ``shared`` and the windows at those in ``cut``, for each document.

    (route, c1, c2, n, content, doc, row, at): where it goes, two hashes of its words, its windows,
    its words joined by spaces, its document and row and its first word.
    """
    names = ["route", "c1", "c2", "n", "content", "doc", "row", "at"]

    def cut_up(words: list[bytes], hashes: np.ndarray, anchors: np.ndarray, first: np.ndarray, n: np.ndarray, shared: np.ndarray, cut: np.ndarray) -> tuple:
        whole, single = _among(anchors, shared), np.flatnonzero(_among(anchors, cut))
        windows = np.concatenate([np.arange(first[k], first[k] + n[k]) for k in single]) if len(single) else first[:0]
        starts, n = np.concatenate([first[whole], windows]), np.concatenate([n[whole], np.ones(len(windows), np.int64)])
        sizes, joined = n + window - 1, b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.concatenate([[0], ends + 1])
        parts = [joined[a:b] for a, b in zip(begins[starts].tolist(), ends[starts + sizes - 1].tolist(), strict=True)]
        c1, c2 = (_sums(hashes, base, starts, sizes) for base in _BASES)
        return np.concatenate([anchors[whole], c1[len(c1) - len(windows) :]]), c1, c2, n, parts, starts

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                docs, ids, texts, *lists = whole.slice(at, 200).columns
                shared, cut = ([x.values.to_numpy().view(np.uint64) for x in column] for column in lists)
                words = [t.as_py().split() for t in texts]
                hashes = [_hashed(x, known) for x in words]
                *own, bounds = stretches_of(hashes, window, anchor)
                parts = [[x[a:b] for x in own] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                found = [cut_up(w, h, *p, a, b) for w, h, p, a, b in zip(words, hashes, parts, shared, cut, strict=True)]
                route, c1, c2, n, starts = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1, 2, 3, 5))
                sizes = [len(f[4]) for f in found]
                columns = [*map(pa.array, (route, c1, c2, n)), pa.array([p for f in found for p in f[4]], pa.binary()), *(pa.array(np.repeat(x.to_numpy(), sizes)) for x in (docs, ids)), pa.array(starts)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(make, "route long, c1 long, c2 long, n long, content binary, doc long, row long, at long")


def _searched(window: int):
    """For a shard's different stretches, the smallest document that has each of their windows."""

    def search(shard: pa.Table) -> pa.Table:
        route, first = shard.column("route").to_numpy(), shard.column("first").to_numpy()
        known, sizes = _Hashes(), shard.column("n").to_numpy()
        owners = np.repeat(first, sizes)
        # A stretch that is alone with its anchor has its windows to itself.
        _, which, many = np.unique(route, return_inverse=True, return_counts=True)
        among = np.flatnonzero(many[which] > 1)
        if len(among):
            contents = [_hashed(x.split(), known) for x in shard.column("content").take(pa.array(among)).to_pylist()]
            index = FMIndex(contents, first[among], window)
            places = np.concatenate([np.arange(s, s + sizes[k]) for s, k in zip(index.starts, among, strict=True)])
            at = np.concatenate([[0], np.cumsum(sizes)])
            where = np.concatenate([np.arange(at[k], at[k + 1]) for k in among])
            owners[where] = np.minimum(owners[where], index.smallest_owners(places, window))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(owners))
        return pa.table([shard.column("c1"), shard.column("c2"), lists], ["s1", "s2", "owners"])

    return search


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, row, spans): for each document the windows that a document of smaller id has too.

    ``row`` is a hash of the text, so that rows of equal ids stay apart; ``spans`` is an array of
    (at, mask), where bit k of the mask is for the window that starts at word at + k.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text")).where("doc is not null and text is not null")
    anchors = Stored(_anchors(rows, window, anchor), "anchors")
    held = anchors.df.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("n")).where("a < b")
    held = Stored(held.select(F.col("anchor").alias("held"), (F.col("n") > CUT).alias("cut")), "held")
    listed = anchors.df.join(held.df, F.col("anchor") == F.col("held")).groupBy("doc").agg(F.collect_set(F.when(~F.col("cut"), F.col("anchor"))).alias("shared"), F.collect_set(F.when(F.col("cut"), F.col("anchor"))).alias("cut"))
    listed = Stored(listed.withColumnRenamed("doc", "listed"), "listed")
    anchors.drop()
    held.drop()
    own = rows.join(listed.df, F.col("doc") == F.col("listed")).select("doc", F.xxhash64("text").alias("row"), "text", "shared", "cut")
    found = Stored(_stretches(own, window, anchor), "stretches", "zstd")
    listed.drop()
    different = Stored(found.df.groupBy("c1", "c2").agg(F.min("doc").alias("first"), F.first("route").alias("route"), F.first("n").alias("n"), F.first("content").alias("content")), "different")
    n_shards = max(1, math.ceil(different.df.count() / SHARD))
    shards = different.df.select("route", "c1", "c2", "n", "content", "first", F.pmod(F.xxhash64("route"), F.lit(n_shards)).alias("shard"))
    owners = Stored(shards.groupBy("shard").applyInArrow(_searched(window), "s1 long, s2 long, owners array<long>"), "owners")
    different.drop()
    masks = F.expr("aggregate(sequence(0, size(owners) - 1), 0L, (s, k) -> s | if(owners[k] < doc, shiftleft(1L, k), 0L))")
    covered = found.df.select("c1", "c2", "doc", "row", "at").join(owners.df, (F.col("c1") == F.col("s1")) & (F.col("c2") == F.col("s2")))
    covered = covered.select("doc", "row", F.struct("at", masks.alias("mask")).alias("span")).where("span.mask <> 0")
    spans = Stored(covered.groupBy("doc", "row").agg(F.collect_set("span").alias("spans")), "spans").df
    found.drop()
    owners.drop()
    return spans


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True) -> DataFrame:
    """Per row: the id, n_words, n_removed, kept_sha256 and, if ``texts``, the text ``kept``.

    Words are runs of other than ASCII white space. A word goes if a window that covers it also
    starts in a document of smaller id; windows are those of the input. Kept words are joined by
    one space. A null text has no words; rows without an id neither lose nor cost words; rows of
    equal id count as one document. Other columns are not returned, so their names can't clash.
    """
    names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    spans = repeated_windows(docs, id_col=id_col, text_col=text_col, window=window, anchor=anchor)
    joined = rows.withColumn("h", F.xxhash64("text")).join(spans, (F.col("id") == F.col("doc")) & (F.col("h") == F.col("row")), "left")
    joined = joined.select("id", "text", F.col("spans.at").alias("at"), F.col("spans.mask").alias("mask"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch, sizes, gone, digests, kept = whole.slice(start, 500), [], [], [], []
                for text, at, mask in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                    words = (text.as_py() or b"").split()
                    sizes.append(len(words))
                    if at.is_valid:
                        bits, first = mask.values.to_numpy(), at.values.to_numpy()
                        starts = np.concatenate([first[(bits >> k) & 1 == 1] + k for k in range(window - anchor + 1)])
                        steps = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + window, minlength=len(words) + 1)
                        covered = np.cumsum(steps)[: len(words)] > 0
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    gone.append(sizes[-1] - len(words))
                    joined = b" ".join(words)
                    digests.append(hashlib.sha256(joined).hexdigest())
                    if texts:
                        kept.append(joined)
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * texts, names)

    found = joined.mapInArrow(remove, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept binary" * texts).withColumnRenamed("id", id_col)
    return found.withColumn("kept", F.col("kept").cast("string")) if texts else found
