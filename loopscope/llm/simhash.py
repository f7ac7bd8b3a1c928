"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint has 64 bits, in three segments (22, 21 and 21 bits, padded to 23). If two differ in at
most two bits, some segment is equal in both, and the segment after it differs in at most two. The
binary Golay code finds such segments by equal keys: every 23-bit word is within 3 bits of just one
codeword, so a word half way between two words at distance 2 has a codeword within 3 bits, which is
within 4 of both. The keys of a word are all codewords within 4 bits: one if it is within 2 of a
codeword, else six. A document's keys are thus (segment, the next segment's codewords), at most 18.

Fingerprints that share a key are verified by counting differing bits. A key that many different
fingerprints share is not paired out: its fingerprints are grouped by the words within one bit of
them instead, of which any two at distance 2 share one and no two farther ones do. Such a group
cannot exceed 65 members, so links grow with the rows, whatever the size of a group of copies.

``similar_documents`` links documents by the similarity of their sets of 5-word shingles instead. A
similarity of 0.8 moves far more than two bits of one fingerprint, so it takes eight independent
fingerprints, over the documents' different words, of which few change where few shingles do, and
the same Golay keys of each: candidates share one of about 128 keys, have fingerprints that are near
as a whole, and are verified on the whole shingle sets. Keys of many documents go by pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopscope.llm import groups, shingles
from loopscope.llm.components import connected
from loopscope.llm.tables import Stored

#: Words in a shingle, bits in which linked fingerprints may differ (the keys serve up to 2).
SHINGLE, BITS = 3, 2
#: Fingerprints of one key that are paired; keys with more go by the words around each.
PAIRED = 32
#: The hash's seed and the Golay code's generator polynomial.
SEED = 42
GENERATOR = 0b110001110101
#: The golden ratio's odd multiplier, and 64 set bits.
_ODD, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_WIDTHS = (22, 21, 21)
#: Fingerprints of a document that is matched by similarity, and the share of their bits in which candidates differ at most.
FINGERPRINTS, APART = 8, 0.2


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text: a bit is set if it is in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    total, counts = len(words) - n + 1, np.zeros(64, np.int64)
    for at in range(0, total, 8192):
        first, last = starts[at : min(at + 8192, total)].tolist(), ends[at + n - 1 : min(at + 8192, total) + n - 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; the fingerprint as a signed number. A text without words, or null, has 0."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(make, "id long, fp long")


def _remainders(words: np.ndarray) -> np.ndarray:
    """The words, as polynomials, modulo the generator."""
    words = words.copy()
    for k in range(22, 10, -1):
        words ^= ((words >> k) & 1) * (GENERATOR << (k - 11))
    return words


def _error_table() -> np.ndarray:
    """For each remainder the error patterns of at most 4 bits that leave it, -1 where there are fewer than 6."""
    patterns = np.zeros(1, np.int64)
    for _ in range(4):
        patterns = np.unique(np.concatenate([patterns, (patterns[:, None] | (1 << np.arange(23))).ravel()]))
    left = _remainders(patterns)
    table, filled = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for k in np.argsort(np.bitwise_count(patterns), kind="stable"):
        table[left[k], filled[left[k]]] = patterns[k]
        filled[left[k]] += 1
    return table


def golay_keys(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For 23-bit words the indices (0 to 4095) of all codewords within 4 bits, -1 where there are fewer than 6."""
    errors = table[_remainders(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def keys_of(fps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of every key of the fingerprints."""
    bits, segments, at = fps.view(np.uint64), [], 0
    for width in _WIDTHS:
        segments.append(((bits >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    rows, keys = [], []
    for t in range(3):
        near = golay_keys(segments[(t + 1) % 3], table)
        row, column = np.nonzero(near >= 0)
        rows.append(row)
        keys.append((t << 40) | (segments[t][row] << 12) | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(distinct: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _error_table()
        for whole in batches:
            for at in range(0, whole.num_rows, 50_000):
                batch = whole.slice(at, 50_000)
                row, key = keys_of(batch.column(1).to_numpy(), table)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["key", "doc", "fp"])

    return distinct.select("doc", "fp").mapInArrow(make, "key long, doc long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what fingerprints at most two bits apart connect.

    ``distinct`` holds each fingerprint once, as (fp, doc) with the document that stands for it.
    """
    sizes = Stored(_keyed(distinct).groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    member = F.struct("fp", "doc")
    shared = Stored(_keyed(distinct).join(sizes.df, "key"), "shared")
    few = shared.df.where(F.col("n") <= PAIRED).groupBy("key").agg(F.sort_array(F.collect_list(member)).alias("m"))
    pairs = few.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    paired = pairs.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= BITS).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    many = shared.df.where(F.col("n") > PAIRED).select("fp", "doc").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)))
    # A word has itself and 64 neighbours, so no list here exceeds 65.
    around = many.select(F.explode(flips).alias("word"), "doc").groupBy("word").agg(F.min("doc").alias("a"), F.collect_set("doc").alias("docs")).where(F.size("docs") > 1)
    found = Stored(paired.unionByName(around.select("a", F.explode("docs").alias("b"))).where("a <> b").distinct(), "links")
    sizes.drop()
    shared.drop()
    return found.df


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Rows whose fingerprints differ in at most two bits are linked; a component is all that links
    reach, named after its smallest id. Texts of any length are hashed whole. Rows without words
    (or with a null text) share fingerprint zero and so are linked. Equal ids are one document. A
    row without an id belongs to its fingerprint's component, which is null if no row there has
    one. Other columns are not returned, so their names can't clash.
    """
    rows = Stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    distinct = Stored(rows.df.groupBy("fp").agg(F.min("id").alias("doc"), F.count("*").alias("n")).where("doc is not null"), "distinct")
    roots = connected(links(distinct.df))
    # Only fingerprints with copies or links need a look-up; every other row is its own component.
    named = distinct.df.join(roots, F.col("doc") == F.col("node"), "left").where("n > 1 or root is not null")
    named = Stored(named.select(F.col("fp").alias("own"), F.coalesce("root", "doc").alias("root")), "roots")
    found = rows.df.join(named.df, F.col("fp") == F.col("own"), "left")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("root", "id").alias("component_id"))


def word_fingerprints(text: bytes, count: int = FINGERPRINTS) -> np.ndarray:
    """``count`` fingerprints over the different words of a text, each by hashes of its own."""
    own = np.unique(shingles.word_runs(text.lower().split(), 1))
    found = np.zeros(count, np.int64)
    for k in range(count if len(own) else 0):
        # Each fingerprint mixes the words' hashes with an odd number of its own.
        x = own * np.uint64((_ODD * (2 * k + 1)) & _ALL)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_ODD)
        x ^= x >> np.uint64(29)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(x), 8192):
            counts += np.unpackbits(x[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        found[k] = np.packbits(counts * 2 > len(x), bitorder="little").view(np.int64)[0]
    return found


def _sketched(own: DataFrame) -> DataFrame:
    """(id, c, n, fps) of (id, text): the hash and size of the shingle set, and the fingerprints."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_ in batches:
            for at in range(0, all_.num_rows, 500):
                batch = all_.slice(at, 500)
                texts = [t.as_py() or b"" for t in batch.column(1)]
                sets = [shingles.shingle_set(t) for t in texts]
                fps = np.concatenate([np.zeros(0, np.int64), *map(word_fingerprints, texts)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * FINGERPRINTS), pa.array(fps))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles.set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), lists], ["id", "c", "n", "fps"])

    return own.mapInArrow(make, "id long, c long, n long, fps array<long>")


def _all_keys(classes: DataFrame) -> DataFrame:
    """(key, c): the Golay keys of all fingerprints of (c, fps)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _error_table()
        for all_ in batches:
            for at in range(0, all_.num_rows, 5_000):
                batch = all_.slice(at, 5_000)
                fps = batch.column(1).flatten().to_numpy().reshape(-1, FINGERPRINTS)
                for k in range(FINGERPRINTS):
                    row, key = keys_of(np.ascontiguousarray(fps[:, k]), table)
                    yield pa.RecordBatch.from_arrays([pa.array(key | k << 44), batch.column(0).take(pa.array(row))], ["key", "c"])

    return classes.select("c", "fps").mapInArrow(make, "key long, c long")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, root): of every document that is linked to others, the smallest id that links reach.

    Documents are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 at least
    and they share a Golay key of a fingerprint; equal sets always are. Texts without words have
    equal sets. Equal ids are one document; rows without an id take no part. Texts of any length are
    read whole. Other columns are not used.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null")
    sketches = Stored(_sketched(own), "sketches").df
    classes = Stored(sketches.groupBy("c").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("fps").alias("fps")), "classes").df
    copies = sketches.join(classes.where("copies > 1").select("c", "rep"), "c").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    keyed = _all_keys(classes.where("n > 0"))
    sizes = Stored(keyed.groupBy("key").agg(F.count("*").alias("k"), F.min("c").alias("a"), F.max("c").alias("b")).where("k > 1"), "sizes").df
    shared = Stored(keyed.join(sizes.where("k > 2").select("key", "k"), "key").join(classes.select("c", "n"), "c"), "shared").df
    pairs = sizes.where("k = 2").select("a", "b").unionByName(groups.pairs_within(shared.where(F.col("k") <= groups.PAIRED), ["n"], shingles.possible)).distinct()
    # Pairs whose fingerprints are far apart as a whole share a key by chance.
    bits = F.aggregate(F.zip_with("fa", "fb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    with_fps = classes.select("c", "n", "fps")
    pairs = pairs.join(with_fps.toDF("a", "na", "fa"), "a").join(with_fps.toDF("b", "nb", "fb"), "b")
    fits = shingles.possible(lambda n: F.col(f"{n}a"), lambda n: F.col(f"{n}b"))
    pairs = Stored(pairs.where(fits & (bits <= APART * 64 * FINGERPRINTS)).select("a", "b"), "pairs").df
    many = shared.where(F.col("k") > groups.PAIRED).select("key", "c", "n")
    wanted = many.select("c").union(pairs.select("a")).union(pairs.select("b")).distinct()
    wanted = Stored(wanted.join(classes, "c").select(F.col("rep").alias("id"), "c"), "wanted").df
    # Rows can repeat an id and a text.
    sets = Stored(shingles.whole_sets(own.join(wanted, "id").select("c", "text")).dropDuplicates(["c"]), "sets").df
    similar = shingles.verified(pairs, sets).where("linked").select("a", "b")
    in_many = shingles.links(many, sets)
    similar = similar if in_many is None else similar.unionByName(in_many)
    named = similar.join(classes.select(F.col("c").alias("a"), F.col("rep").alias("ra")), "a").join(classes.select(F.col("c").alias("b"), F.col("rep").alias("rb")), "b")
    return connected(Stored(copies.unionByName(named.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges").df)
