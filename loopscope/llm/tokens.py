"""Exact token counts at every prefix of a text, for a byte-level BPE vocabulary.

A BPE encoding has one token that ends at each byte of a piece, and a token may follow another
exactly if the two, encoded alone, stay as they are. So the last token of every prefix of a piece
follows from the last tokens of shorter prefixes, and its count is one more than that of the prefix
before it. Pieces are what the vocabulary's splitting pattern makes of a text; their counts are
kept per piece, and a text's counts are those of its pieces laid end to end.

The stored form is one signed step a byte, so the count of any prefix is a sum: truncation and
budget questions need no second encoding (``count_at``, ``longest_within``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's contractions and character classes.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPLIT = "|".join(CONTRACTIONS) + r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of pieces and their steps kept per worker, with OVERHEAD for each piece, and pairs of tokens; beyond
#: it a store starts again. Longer pieces than LONG_PIECE are not kept.
MOST_BYTES, OVERHEAD, MOST_PAIRS, LONG_PIECE = 200_000_000, 200, 2_000_000, 4_096
#: The width byte of stored steps.
NARROW, WIDE = b"\x01", b"\x04"


class PrefixCounter:
    """Token counts at every byte prefix, by the tokenizer file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(Tokenizer.from_file(path).to_str())
        # The longest of those that start at one place is taken.
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        shown = dict(zip(_byte_order(), map(chr, _shown_order()), strict=True))
        hidden = {c: b for b, c in shown.items()}
        self.vocab = {bytes(hidden[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in hidden for c in t)}
        self.texts = {i: t for t, i in self.vocab.items()}
        self.longest = max(map(len, self.vocab))
        self._encode, self._shown = Tokenizer.from_file(path).model.tokenize, shown
        self._own: dict[int, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._split = regex.compile(SPLIT)
        self._twice = regex.compile(r"\p{White_Space}\p{White_Space}")
        self._pieces = _Pieces(self)

    def _alone(self, data: bytes) -> list[int]:
        return [t.id for t in self._encode("".join(map(self._shown.__getitem__, data)))]

    def _follows(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > MOST_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._alone(self.texts[a] + self.texts[b]) == [a, b]
        return known

    def _stays(self, token: int) -> bool:
        known = self._own.get(token)
        if known is None:
            known = self._own[token] = self._alone(self.texts[token]) == [token]
        return known

    def piece_counts(self, piece: bytes) -> list[int]:
        """The number of tokens of each prefix of one piece, from the empty prefix on."""
        counts, last, known = [0], [-1], 0
        get = self.vocab.get
        for end in range(1, len(piece) + 1):
            # Only one token can be the last; most often it is the one before, a byte longer.
            for start in (known, *range(end - 1, known, -1), *range(known - 1, max(-1, end - self.longest - 1), -1)):
                token = get(piece[start:end])
                if token is not None and (self._follows(last[start], token) if start else self._stays(token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    known = start
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece!r}")
        return counts

    def _steps(self, text: str) -> np.ndarray:
        """The steps of a text without special strings, with white space runs of several characters."""
        counts: list[np.ndarray] = []
        base, pieces, k = 0, self._split.findall(text), 0
        while k < len(pieces):
            piece = pieces[k]
            own = np.cumsum(np.frombuffer(self._pieces[piece], np.int8), dtype=np.int64)
            if piece.isspace() and k + 1 < len(pieces) and pieces[k + 1][0].isspace():
                # A run of white space is one piece as long as nothing follows it.
                head = pieces[k + 1][0].encode()
                whole = self.piece_counts(piece.encode() + head)
                after = own[-1] + np.cumsum(np.frombuffer(self._pieces[pieces[k + 1]], np.int8), dtype=np.int64)
                after[: len(head)] = whole[len(own) + 1 :]
                counts += [base + np.array(whole[1 : len(own) + 1]), base + after]
                base += int(own[-1]) + self._total(pieces[k + 1])
                k += 2
                continue
            counts.append(base + own)
            base += int(own[-1])
            k += 1
        return np.diff(np.concatenate(counts), prepend=0) if counts else np.zeros(0, np.int64)

    def _total(self, piece: str) -> int:
        return int(np.frombuffer(self._pieces[piece], np.int8).sum(dtype=np.int64))

    def _plain(self, text: str) -> tuple[np.ndarray, int]:
        """The steps and the total of a text in which no special string is taken as such."""
        if self._twice.search(text) or "\x00" in text:
            steps = self._steps(text)
            return steps, int(steps.sum())
        steps = np.frombuffer(b"".join(map(self._pieces.__getitem__, self._split.findall(text))), np.int8)
        return steps, int(steps.sum(dtype=np.int64))

    def steps(self, text: str) -> np.ndarray:
        """The count at byte k of the text less that at byte k - 1, for each byte."""
        parts: list[np.ndarray] = []
        at = 0
        for found in self._special.finditer(text) if self._special else ():
            head, special, at = text[at : found.start()], found.group(), found.end()
            # Up to its last character a special string is ordinary text, that can hold a shorter one.
            ordinary = self.steps(head + special[:-1])
            last = np.zeros(len(special[-1].encode()), np.int64)
            last[-1] = self._plain(head)[1] + 1 - ordinary.sum(dtype=np.int64)
            parts += [ordinary, last]
        parts.append(self._plain(text[at:])[0])
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


class _Pieces(dict):
    """Steps of each piece, as bytes of signed 8-bit numbers; what is held has a bound in bytes."""

    def __init__(self, counter: PrefixCounter):
        self.counter, self.held = counter, 0

    def __missing__(self, piece: str) -> bytes:
        if len(piece) == 3 and piece in CONTRACTIONS:
            # Cut short, a contraction is an apostrophe and a word.
            counts = [0, 1, 2, self.counter.piece_counts(piece.encode())[-1]]
        else:
            counts = self.counter.piece_counts(piece.encode())
        found = bytes([(b - a) & 255 for a, b in pairwise(counts)])
        if len(found) <= LONG_PIECE:
            self.held += len(piece) + len(found) + OVERHEAD
            if self.held > MOST_BYTES:
                self.clear()
                self.held = len(piece) + len(found) + OVERHEAD
            self[piece] = found
        return found


def _byte_order() -> list[int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return plain + [b for b in range(256) if b not in set(plain)]


def _shown_order() -> list[int]:
    order = _byte_order()
    return order[:188] + [256 + k for k in range(len(order) - 188)]


def pack(steps: np.ndarray) -> bytes:
    """Steps as stored: a width byte, then signed 8-bit steps, or 32-bit ones where they don't fit."""
    if steps.dtype == np.int8 or not len(steps) or (-128 <= steps.min() and steps.max() <= 127):
        return NARROW + steps.astype(np.int8).tobytes()
    return WIDE + steps.astype("<i4").tobytes()


def counts_of(stored: bytes) -> np.ndarray:
    """The count at every byte prefix, the empty one first."""
    steps = np.frombuffer(stored[1:], np.int8 if stored[:1] == NARROW else "<i4")
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def count_at(stored: bytes, n_bytes: int) -> int:
    """Tokens of the first ``n_bytes`` bytes (at a character's end)."""
    return int(counts_of(stored)[n_bytes])


def longest_within(stored: bytes, budget: int) -> int:
    """Bytes of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts_of(stored) <= budget)[-1])


def prefix_token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, prefixes: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit and, if ``prefixes``, the stored ``prefix_steps``.

    A null text counts as empty: no bytes, no tokens. Texts of any length are taken whole; repeated
    rows and ids give a row each. Other columns are not returned, so their names can't clash.
    ``tokenizer`` is the path of a tokenizers file that each worker can read.
    """
    names = ["id", "n_bytes", "n_tokens"] + ["prefix_steps"] * prefixes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sizes, totals, stored = [], [], []
                for text in batch.column(1).to_pylist():
                    steps = counter.steps(text) if text else np.zeros(0, np.int8)
                    sizes.append(len(steps))
                    totals.append(int(steps.sum(dtype=np.int64)))
                    if prefixes:
                        stored.append(pack(steps))
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(stored, pa.binary())] * prefixes, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long" + ", prefix_steps binary" * prefixes
    found = rows.mapInArrow(count, schema).withColumnRenamed("id", id_col)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
