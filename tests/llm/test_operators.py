"""The training-data operators against brute force, and on odd rows."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loopscope.llm import ann, components, contamination, groups, langid, lines, mixing, quality, simhash, substring, tokens, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use within themselves or return.
CLASHING = ("id", "fp", "rep", "n_words", "pos", "score", "component_id", "n_removed", "payload_digest", "copy", "k0", "lines", "row")


@pytest.fixture(scope="module")
def corpus():
    """Documents with copies, near copies, shared passages, odd characters, nulls and empty texts."""
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    line = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage = line(30)
    rows = []
    for k in range(60):
        text = "\n".join(line(draw.randint(1, 40)) for _ in range(draw.randint(1, 6)))
        if k % 5 == 0:
            text += f" {passage} {line(4)}"
        rows.append(text)
    rows += rows[:6] + [t.replace(vocabulary[3], "x") for t in rows[6:14]] + ["", None, "   \n\t", "!!! ---\n###", "é ñ ß ü x 你好", line(5000), "a  b\n\n c" + passage[:-1]]
    return [(k, t, ("en", "de", None)[k % 3], f"s{k % 3}" if k % 11 else None, len(t or "")) for k, t in enumerate(rows)] + [(3, rows[3], "en", "s0", 1), (None, rows[4], "en", "s0", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Token counts


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_prefix_counts_are_those_of_the_library(vocabulary):
    from tokenizers import Tokenizer

    library, counter = Tokenizer.from_file(vocabulary), tokens.PrefixCounter(vocabulary)
    for text in ["hello world", "a  b", "a\n\n b  \n", "x 're reading'll ''s", "é ü 你好 😀😀", "<|endoftext|>a<|endoftext|> <|endof", "  lead", "tail   ", "x 　z\x1c\x1dq\x85r", "!!!'s ,'re's I'll", "\0 \0\0a", "thththething" * 9]:
        stored = tokens.pack(counter.steps(text))
        for k in range(len(text) + 1):
            assert tokens.count_at(stored, len(text[:k].encode())) == len(library.encode(text[:k], add_special_tokens=False).ids), (text, k)


def test_counts_hold_with_several_special_strings_and_a_full_store(monkeypatch, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    library.add_special_tokens(["<s>", "<s>>", "«é»"])
    library.save(str(tmp_path / "several.json"))
    monkeypatch.setattr(tokens, "MOST_BYTES", 2_000)
    counter = tokens.PrefixCounter(str(tmp_path / "several.json"))
    draw = random.Random(4)
    for _ in range(40):
        text = "".join(draw.choice(["<s>", "<s>>", "«é»", "«é", "<|endoftext|>", " some", "words", "  ", "\n", "<", ">"]) for _ in range(12))
        stored = tokens.pack(counter.steps(text))
        for k in range(len(text) + 1):
            assert tokens.count_at(stored, len(text[:k].encode())) == len(library.encode(text[:k], add_special_tokens=False).ids), (text, k)
    for k in range(3000):
        counter.steps(f"a{k}  b{k}")
    assert sum(len(p) + len(s) + tokens.OVERHEAD for p, s in counter._pieces.items()) <= 2_000


def test_budgets_need_no_second_encoding(vocabulary):
    stored = tokens.pack(tokens.PrefixCounter(vocabulary).steps("some words of a longer text"))
    counts = tokens.counts_of(stored)
    for budget in range(8):
        assert tokens.longest_within(stored, budget) == max(k for k, n in enumerate(counts) if n <= budget)
    wide = np.array([1, 300, -299])
    assert list(tokens.counts_of(tokens.pack(wide))) == [0, 1, 301, 2]


def test_token_counts(docs, clashing, none, corpus, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    expected = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in corpus), key=repr)
    for df in (docs, clashing):
        found = tokens.prefix_token_counts(df, vocabulary, limit=100)
        assert rows_of(found.select("doc_id", "n_bytes", "n_tokens")) == expected
        assert found.where("over_limit <> (n_tokens > 100)").count() == 0
    assert tokens.prefix_token_counts(none, vocabulary).count() == 0


# SimHash


def brute_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def joined(links, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("paired", [1, 32])
def test_simhash_components(monkeypatch, docs, clashing, none, corpus, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    own = [(i, brute_fingerprint(t, 3)) for i, t, *_ in corpus if i is not None]
    roots = joined([(a, b) for a, x in own for b, y in own if (x ^ y).bit_count() <= 2], {i for i, _ in own})
    for df in (docs, clashing):
        found = rows_of(simhash.near_duplicates(df.where("doc_id is not null")))
        assert found == sorted(((i, f"{x:016x}", roots[i]) for i, x in own), key=repr)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(docs).count() == len(corpus)


def test_golay_keys_meet_at_two_bits():
    table, draw = simhash._error_table(), np.random.default_rng(0)
    assert (table >= 0).sum() == sum(math.comb(23, k) for k in range(5))
    fps = draw.integers(-(2**63), 2**63 - 1, 200)
    for _ in range(5):
        flipped = fps.view(np.uint64) ^ (np.uint64(1) << draw.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 200).astype(np.uint64))
        own, other = (defaultdict(set) for _ in range(2))
        for sets, x in ((own, fps), (other, flipped.view(np.int64))):
            for row, key in zip(*simhash.keys_of(x, table), strict=True):
                sets[row].add(key)
        assert all(own[k] & other[k] for k in range(200))


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(70)] + [(100, 101), (101, 100), (5, 5), (7, None)]
    found = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {k: 0 for k in range(71)} | {100: 100, 101: 100}


# Repeated passages


def brute_removal(corpus):
    first = {}
    for i, t, *_ in corpus:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    out = []
    for i, t, *_ in corpus:
        w = (t or "").encode().split()
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("cut", "shard"), [(1000, 20_000), (2, 50)])
def test_repeated_passages(monkeypatch, docs, clashing, none, corpus, cut, shard):
    monkeypatch.setattr(substring, "CUT", cut)
    monkeypatch.setattr(substring, "SHARD", shard)
    assert rows_of(substring.remove_repeated(docs, texts=False)) == brute_removal(corpus)
    found = substring.remove_repeated(clashing).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert rows_of(found) == brute_removal(corpus)
    assert substring.remove_repeated(none).count() == 0


def test_stretches_of_several_documents_are_those_of_each():
    draw = np.random.default_rng(2)
    lists = [draw.integers(0, 40, n).astype(np.uint64) for n in (0, 30, 12, 13, 200, 0, 5, 14, 0)]
    *found, bounds = substring.stretches_of(lists)
    for hashes, a, b in zip(lists, bounds[:-1], bounds[1:], strict=True):
        grams = substring._runs(hashes, substring.ANCHOR).tolist()
        width = substring.WINDOW - substring.ANCHOR + 1
        at = [min(range(k, k + width), key=grams.__getitem__) for k in range(len(hashes) - substring.WINDOW + 1)]
        first = [k for k in range(len(at)) if k == 0 or at[k] != at[k - 1]]
        assert [x[a:b].tolist() for x in found] == [[grams[at[k]] for k in first], first, [y - x for x, y in zip(first, [*first[1:], len(at)])]]


def test_wavelet_ranks_and_backward_search():
    draw = np.random.default_rng(1)
    text = draw.integers(0, 11, 500)
    matrix = substring.WaveletMatrix(text, 4)
    symbols, lo, hi = draw.integers(0, 11, 300), draw.integers(0, 501, 300), draw.integers(0, 501, 300)
    a, b = matrix.spans(symbols, lo, hi)
    assert [int((text[:x] == s).sum()) for s, x in zip(symbols, lo, strict=True)] == list(a)
    assert [int((text[:x] == s).sum()) for s, x in zip(symbols, hi, strict=True)] == list(b)
    sequences = [draw.integers(0, 3, n).astype(np.uint64) for n in (5, 20, 30, 9)]
    index = substring.FMIndex(sequences, np.array([4, 2, 9, 7]), 5)
    everywhere = [(s, k) for s in range(4) for k in range(len(sequences[s]) - 4)]
    found = index.smallest_owners(np.array([index.starts[s] + k for s, k in everywhere]), 5)
    for (s, k), owner in zip(everywhere, found, strict=True):
        having = [o for q, o in zip(sequences, (4, 2, 9, 7), strict=True) for j in range(len(q) - 4) if (q[j : j + 5] == sequences[s][k : k + 5]).all()]
        assert owner == (min(having) if len(having) > 1 else np.iinfo(np.int64).max)


# Decontamination


def test_contained_items(spark, docs, clashing, none, corpus):
    texts = {i: t for i, t, *_ in corpus if i is not None and t}
    items = [(1, " ".join(texts[0].split()[:20])), (2, texts[20].upper()), (3, "a b"), (4, None), (5, ""), (6, "not in any document of this corpus at all"), (1, " ".join(texts[0].split()[:20])), (None, texts[1])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())
    runs = lambda t, n: {tuple(w[k : k + n]) for w in [words(t)] for k in range(len(w) - n + 1)}
    items += [(7, " ".join(texts[8].split()[2:5])), (8, texts[21].split()[1] + "!")]
    expected = []
    for i, t, *_ in corpus:
        for j, x in {(j, x) for j, x in items if j is not None and x}:
            n = min(5, len(words(x)))
            own = runs(x, n)
            if own and t and len(own & runs(t, n)) >= 0.8 * len(own):
                expected.append((i, j, len(own & runs(t, n)), len(own)))
    table = spark.createDataFrame(items, "item_id long, text string")
    for df, size in ((docs, contamination.BLOCK_BYTES), (clashing, 200)):
        found = contamination.contained_items(df, table.withColumn("doc_id", F.lit(1)), block_bytes=size)
        assert rows_of(found.select("doc_id", "item_id", "n_shared", "n_shingles")) == sorted(expected, key=repr)
        clean = contamination.clean_rows(df, table, block_bytes=size)
        assert clean.columns == df.columns
        leaked = {i for i, *_ in expected}
        assert sorted([r["doc_id"] for r in clean.collect()], key=repr) == sorted([i for i, t, *_ in corpus if i not in leaked], key=repr)
    assert len(expected) >= 3 and {7, 8} <= {j for _, j, *_ in expected}
    assert contamination.clean_rows(none, table).count() == 0
    assert contamination.contained_items(none, table).count() == 0
    assert contamination.contained_items(docs, table.limit(0)).count() == 0


def test_sketches_miss_nothing():
    for size in range(1, 200):
        kept = contamination.sketch_length(size)
        assert 1 <= kept <= size and size - kept < 0.8 * size


# Language


def test_language_of_odd_rows(spark, docs, clashing, none, corpus):
    rows = [(k, ("the quick brown fox and the dog " if k % 2 else "der schnelle braune fuchs und der hund ") * 3, "en" if k % 2 else "de", "s", 1) for k in range(40)]
    profiles = langid.fit(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") > 3)
    assert profiles.languages == ["de", "en"]
    odd = spark.createDataFrame([(1, "und der hund"), (2, "THE DOG AND THE FOX"), (3, None), (4, ""), (5, "123 !!"), (6, "𝒳𝒴 你")], "doc_id long, text string").withColumn("lang_pred", F.lit("x")).withColumn("k0", F.lit(1))
    found = {r["doc_id"]: r for r in langid.predict(odd, profiles).collect()}
    assert [found[k]["lang_pred"] for k in range(1, 6)] == ["de", "en", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.predict(clashing, profiles).count() == len(corpus)
    assert langid.predict(none, profiles).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(none, F.lit(True))).collect()} == {"und"}


def test_out_of_place_distance():
    profiles = langid.Profiles({"a": np.array([5, 7, 9]), "b": np.array([9, 5])})
    assert list(profiles.distances(np.array([5, 9, 4]))) == [0 + 1 + langid.PROFILE, 1 + 1 + langid.PROFILE]


def test_gram_counts():
    grams, counts = langid._Grams().counts("Ab, ab!")
    expected = Counter(s[k : k + n] for s in ["_ab_ab_"] for n in langid.LENGTHS for k in range(len(s) - n + 1))
    del expected["_"]
    assert sorted(counts) == sorted(expected.values())


# Quality


def test_quality_learns_and_scores(spark, docs, clashing, none, corpus):
    good = [(k, "These are plain words, one after another. " * (1 + k % 4)) for k in range(60)]
    bad = [(100 + k, "BUY!!! $$$ ### NOW | " * (1 + k % 4)) for k in range(60)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100), None) for i, _ in good + bad] + [(None, 1, 1), (1, None, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    rules = quality.fit(table, labels, F.col("doc_id") % 5 != 0)
    assert rules.rules
    found = {r["doc_id"]: r for r in quality.score(table, rules).collect()}
    assert all(found[i]["predicted"] == int(i < 100) for i in found)
    for df in (docs, clashing):
        scored = quality.score(df, rules)
        assert scored.count() == len(corpus) and scored.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    assert quality.score(none, rules).count() == 0
    constant = quality.fit(none, labels, F.lit(True))
    assert {r["score"] for r in quality.score(docs, constant).collect()} == {0.5}


def test_rules_compile_to_what_they_say(spark, docs):
    rules = quality.RuleEnsemble(-0.5, ((frozenset({(0, 3.0, True), (1, 0.2, False)}), 1.5), (frozenset({(2, 0.5, True)}), -2.0)))
    for r in quality.statistics(docs, ["doc_id"]).withColumn("score", rules.score()).collect():
        total = -0.5 + 1.5 * (r["log_bytes"] > 3 and r["upper"] <= 0.2) - 2.0 * (r["lower"] > 0.5)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))


# WARC


@pytest.fixture(scope="module")
def pages(spark):
    noise = random.Random(3).randbytes(40_000).hex()
    rows = [(k, f"http://h/{k}?q= x", f"<p>{k % 7}</p>" * (k % 3) + ("é" * k if k % 4 else "")) for k in range(50)] + [(60, None, None), (61, "u", ""), (62, "u", noise), (63, "u\r\nv", noise), (63, "w", noise), (None, "n", "only"), (70, "u", "\x1f\x8b\x08 WARC/1.1")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("least", [0, 30])
def test_pages_come_back(pages, least):
    rows, df = pages
    largest = {}
    for i, _, h in rows:
        h = (h or "").encode()
        largest[h] = max(largest.get(h, -1), -1 if i is None else i)
    expected = []
    for i, _, h in rows:
        h = (h or "").encode()
        own = i == largest[h] or len(h) < least or largest[h] < 0
        expected.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if own else "revisit", None if own else largest[h]))
    found = warc.archived_pages(df.withColumn("payload_digest", F.lit(1)).withColumn("id", F.lit("z")), least_bytes=least)
    assert rows_of(found) == sorted(expected, key=repr)


def test_archives_are_gzip_members_and_ranges_own_their_records(spark, pages):
    rows, df = pages
    path = warc.write_archives(df)
    plain = warc.read_archives(spark, path)
    assert plain.count() == len(rows)
    held = [(r["record_id"], r["start"], r["payload"]) for r in plain.collect()]
    for size in (100, 777, 5000):
        assert sorted((r["record_id"], r["start"], r["payload"]) for r in warc.read_archives(spark, path, range_bytes=size).collect()) == sorted(held)
    folder = path.removeprefix("file://")
    for name in os.listdir(folder):
        if name.startswith("part-"):
            assert gzip.open(f"{folder}/{name}").read().count(b"WARC/1.1\r\nWARC-Type") == sum(r["path"].endswith(name) for r in plain.select("path").collect())


def test_magic_inside_a_record_is_no_record(tmp_path):
    inner = warc.record_of("urn:page:9", "u", b"inner", None)
    outer = gzip.compress(warc.record_of("urn:page:1", "u", b"x", None) and (b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(inner)) + inner, 0, mtime=0)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(outer + warc.record_of("urn:page:2", "u", b"y", None))
    archive = warc._Archive(str(path))
    for size in (7, 60, 10_000):
        starts = [at for a in range(0, archive.size, size) for at, _ in warc.records_in(archive, a, min(a + size, archive.size))]
        assert starts == [0, len(outer)]


def test_no_pages(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_records_end_in_a_zero_byte():
    assert warc.record_of("urn:page:1", None, b"\0" * (17 << 20), None)[-1] == 0


# Lines


def line_words(x):
    return [w for w in re.split("[ \t\r]", x.lower()) if w]


def line_print(x):
    """The fingerprint of a normalised line, None if it is matched as it is."""
    words = x.split(" ")
    long = [w for w in words if len(w) >= lines.LONG]
    if len(words) >= lines.LEAST_WORDS:
        h = [xxhash.xxh64_intdigest(w, seed=42) for w in (long if len(long) >= lines.LEAST_WORDS else dict.fromkeys(words))]
    elif len(x) >= lines.LEAST_CHARS:
        h = []
        for k in range(len(x) - 2):
            seed = 42
            for c in x[k : k + 3]:
                seed = xxhash.xxh64_intdigest(c, seed=seed)
            h.append(seed)
    else:
        return None
    return sum(1 << b for b in range(lines.WIDTH) if 2 * sum(v >> b & 1 for v in h) > len(h))


def line_similar(a, b):
    row = list(range(len(b) + 1))
    for k, c in enumerate(a):
        new = [k + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1] <= 0.2 * max(len(a), len(b)) + 1e-9


def brute_lines(rows):
    """Which (id, place) are left out, by the rule on all pairs of lines."""
    first, places = {}, []
    for i, t in rows:
        if i is None or t is None:
            continue
        for p, x in enumerate(t.split("\n")):
            if line_words(x):
                places.append((i, p, " ".join(line_words(x))))
    for i, p, x in sorted(places):
        first.setdefault(x, (i, p))
    prints = [(x, f) for x in first if (f := line_print(x)) is not None]
    near = [(x, y) for k, (x, f) in enumerate(prints) for y, g in prints[k + 1 :] if (f ^ g).bit_count() <= lines.BITS]
    groups = joined([(x, y) for x, y in near if line_similar(x, y)], set(first))
    kept = {}
    for x, g in groups.items():
        kept[g] = min(kept.get(g, first[x]), first[x])
    return {(i, p) for i, p, x in places if (i, p) != kept[groups[x]]}


@pytest.mark.parametrize("paired", [3, 32])
def test_fuzzy_lines(monkeypatch, spark, corpus, paired):
    monkeypatch.setattr(lines, "PAIRED", paired)
    draw = random.Random(5)
    rows = [(i, t) for i, t, *_ in corpus if t is None or len(t) < 3000]
    base = " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    for k in range(25):
        w = base.split()
        w[draw.randrange(60)] = "zz"
        rows.append((1000 + k, " ".join(w) + "\nTotal: 12, 5\n\n" + " ".join(w).upper() + "!"))
    # Lines of one fingerprint, few of which are similar; texts without blanks; short lines.
    five = "alphas bravos charlie deltas echoes"
    for k in range(12):
        rows.append((2000 + k, f"{' '.join(draw.choice('xyz') * draw.randint(1, 3) for _ in range(14))} {five}"))
    rows += [(2100, f"a b c d e f g h i j k l m n {five}"), (2101, f"a b c d e f g h i j k l m o {five}")]
    rows += [(2200 + k, "".join(chr(0x4E00 + 7 * j) for j in range(300)) + "\u597d" * k) for k in range(5)] + [(2300, "Item 12"), (2301, "Item 13")]
    gone = brute_lines(rows)
    assert any(p == 0 and 1000 < i < 2000 for i, p in gone) and (2101, 0) in gone and any((2200 + k, 0) in gone for k in range(5)) and (2301, 0) not in gone
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHING if c != "lines"}).repartition(3)
    found = lines.dedup_lines(df)
    assert "component_id" in found.columns
    expected = []
    for i, t in rows:
        out = {p for j, p in gone if j == i} if t is not None and i is not None else set()
        left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in out)
        expected.append((i, left, 0 if t is None else t.count("\n") + 1, len(out)))
    assert rows_of(found.select("doc_id", "text", "n_lines", "n_removed")) == sorted(expected, key=repr)


def test_unrelated_lines_part_no_similar_ones(spark):
    five = "alphas bravos charlie deltas echoes"
    draw = random.Random(9)
    pair = [(1, f"a b c d e f g h i j k l m n {five}"), (2, f"a b c d e f g h i j k l m o {five}")]
    others = [(10 + k, " ".join(draw.choice("pqrstuvw") for _ in range(14)) + f" {five}") for k in range(60)]
    for rows in (pair, pair + others[:6], pair + others):
        found = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert (found[1], found[2]) == (0, 1)


def test_keys_miss_no_line_within_the_bits():
    draw, masks = random.Random(3), lines._masks()
    assert all(any(not m & bits for m in masks) for bits in (sum(1 << b for b in draw.sample(range(lines.WIDTH), lines.BITS)) for _ in range(20_000)))
    # A key has enough bits for unlike lines to share few.
    assert min(m.bit_count() for m in masks) >= 28


def test_lines_that_differ_in_bits_all_over_are_linked(spark):
    draw, rows = random.Random(4), []
    blocks = lambda x: [x >> 15 * k & 0x7FFF for k in range(4)]
    while len(rows) < 40:
        words = ["".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(40)]
        other = [*words[:-1], "".join(draw.choice("klmnop") for _ in range(7))]
        one, two = line_print(" ".join(words)), line_print(" ".join(other))
        if 3 <= (one ^ two).bit_count() <= lines.BITS and sum(map(int.__eq__, blocks(one), blocks(two))) < 2:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    found = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i % 2 for i, _ in rows}


def test_long_lines_are_compared_as_a_whole(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(1400)]
    rows = [(1, " ".join(words))]
    for k, n in enumerate((15, 30, 45)):
        rows.append((2 + k, " ".join(words[:700] + [f"{j}" for j in range(10, 10 + n * 3)] + words[700:])))
    rows.append((9, " ".join(words[:900] + words[:500])))
    found = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 1, 3: 1, 4: 1, 9: 0}


def test_blanks_of_inserted_words_count(spark):
    # 44 characters of 220, blanks included, are near; 45 of 221 are not, though the words without their last blank are 44.
    words = [x * 8 for x in "bcdefghijklmnopqrst"] + ["uuuuuu"]
    rows = [(1, " ".join(words)[:176]), (2, " ".join([*words[:9], *["abcd"] * 8, "abc", *words[9:]])[:220])]
    rows += [(i + 2, t.replace("bbbb", "vvvv")) for i, t in rows[:1]] + [(4, " ".join([*words[:9], *["abcd"] * 9, *words[9:]])[:221].replace("bbbb", "vvvv"))]
    assert [len(t) for _, t in rows] == [176, 220, 176, 221]
    found = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 1, 3: 0, 4: 0}
    assert brute_lines(rows) == {(2, 0)}


@pytest.mark.parametrize("free", [0, 1, 2])
def test_bundles_have_every_key_once_and_bits_in_common(free):
    bundles = lines._bundles(free)
    assert sorted(m for b in bundles for m in b) == sorted(lines._masks())
    assert all(reduce(int.__and__, b).bit_count() >= (lines.WIDTH >> free + 1) - 1 for b in bundles)
    assert len(bundles) == (64 >> free) - 1 + free


@pytest.mark.parametrize(("free", "n"), [(0, 400), (1, 400), (2, 400), (2, 1 << 40)])
def test_fingerprints_come_together_once_for_all_keys_of_a_bundle(spark, free, n):
    draw = random.Random(5)
    prints = {draw.getrandbits(lines.WIDTH) for _ in range(200)}
    prints |= {x ^ sum(1 << b for b in draw.sample(range(lines.WIDTH), lines.BITS)) for x in list(prints)}
    bundles = lines._bundles(free)
    gathered = lines._gathered(spark.createDataFrame([(x,) for x in prints], "fp long"), n, bundles)
    sizes = {m: Counter(x & m for x in prints) for b in bundles for m in b}
    assert sorted(map(tuple, gathered.collect())) == sorted((m, x) for m, keys in sizes.items() for x in prints if keys[x & m] > 1)


@pytest.mark.parametrize("n", [100, 200])
def test_groups_of_copies_have_about_as_many_edges_as_members(monkeypatch, spark, n):
    draw, sizes = random.Random(5), []
    rows = [(key, c) for key in range(40) for c in draw.sample(range(n), n // 2)]
    monkeypatch.setattr(groups, "connected", lambda edges: sizes.append(edges.count()) or components.connected(edges))
    linked = lambda pairs, _: pairs.withColumns({"j": F.lit(1.0), "linked": F.lit(True)})
    found, roots = groups.links_by_pivots(spark.createDataFrame(rows, "key long, c long"), [], linked, lambda a, b: F.lit(True), lambda a, b: F.lit(True))
    assert {r["root"] for r in components.connected(found).collect()} == {0} and roots.count() == n
    assert sizes[0] <= 1.5 * n


def test_what_rounds_of_pivots_leave_is_compared_at_once(spark):
    calls = []

    def linked(pairs, whole):
        calls.append(whole)
        return pairs.withColumns({"j": F.lit(0.0), "linked": (F.col("a") - F.col("b")) % 10 == 0})

    rows = [(0, c) for c in range(60)]
    found, _ = groups.links_by_pivots(spark.createDataFrame(rows, "key long, c long"), [], linked, lambda a, b: F.lit(True), lambda a, b: F.lit(True))
    roots = {r["node"]: r["root"] for r in components.connected(found).collect()}
    assert roots == {c: c % 10 for c in range(60)}
    # Four rounds, what they leave, and what they reach.
    assert calls == [True] * groups.ROUNDS + [False] * 2


@pytest.mark.parametrize(("ids", "packed"), [((-(2**63), 2**63 - 1, 0, 7), False), ((-(2**63), -(2**63) + 3, -(2**63) + 1, -(2**63) + 2), True), ((2**63 - 1, 2**63 - 4, 2**63 - 3, 2**63 - 2), True), ((3, -4, 0, 9), True)])
def test_places_of_any_ids_are_in_order(spark, ids, packed):
    base = [f"bravos{k} charlie{k}" for k in range(12)]
    one, two = " ".join(base), " ".join([*base, "a"])
    rows = [(i, f"line {i % 1000}\n\n{x}\nTotal: 12\nTotal: 12") for i, x in zip(ids, (one, two, one, one), strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.Places(lines._lines(df.withColumnRenamed("doc_id", "id")))
    places = df.select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos")).withColumn("place", found.of())
    assert found.packed == packed and [(r[0], r[1]) for r in places.orderBy("place").collect()] == [(i, k) for i in sorted(ids) for k in range(5)]
    assert places.where((found.id("place") != F.col("id")) | (found.pos("place") != F.col("pos"))).count() == 0
    gone = brute_lines(rows)
    left = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone), 5, len([p for j, p in gone if j == i])) for i, t in rows]
    assert len(gone) == 10 and rows_of(lines.dedup_lines(df)) == sorted(left, key=repr)


def test_line_fingerprints_of_any_length(spark):
    draw = np.random.default_rng(1)
    rows = [(n, draw.integers(-(2**63), 2**63 - 1, n).tolist()) for n in (0, 1, 2, 5, 126, 127, 128, 129, 254, 255, 1000)]
    found = dict(map(tuple, spark.createDataFrame(rows, "i long, hashes array<long>").selectExpr("i", lines.simhash("hashes")).collect()))
    for n, hashes in rows:
        assert found[n] == sum(1 << b for b in range(lines.WIDTH) if 2 * sum(h >> b & 1 for h in hashes) > n)


def test_line_fingerprints_about_the_sizes_of_parts(spark):
    draw = np.random.default_rng(2)
    sizes = (15, 16, 30, 31, 45, 46, 59, 60, 61, 75, 119, 120, 121)
    # Random hashes, and some of which all have all bits or none.
    rows = [(n, kind, [-1] * n if kind == 1 else [0] * n if kind == 2 else draw.integers(-(2**63), 2**63 - 1, n).tolist()) for n in sizes for kind in range(3)]
    made = spark.createDataFrame([*rows, (-1, 0, None)], "i long, kind long, hashes array<long>")
    found = {(r[0], r[1]): r[2] for r in made.selectExpr("i", "kind", lines.simhash("hashes")).collect()}
    assert found.pop((-1, 0)) is None
    assert found == {(n, kind): sum(1 << b for b in range(lines.WIDTH) if 2 * sum(h >> b & 1 for h in hashes) > n) for n, kind, hashes in rows}


def test_lines_of_up_to_120_words_are_counted_in_compiled_form(spark):
    draw = random.Random(6)
    rows = [(n, " ".join("".join(draw.choice("abcdefgh") for _ in range(7)) for _ in range(n))) for n in (1, 5, 59, 60, 61, 119, 120, 121, 130, 300)]
    made = lines._lines(spark.createDataFrame(rows, "id long, text string"))
    assert {r["id"]: r["fp"] for r in made.collect()} == {i: line_print(t) for i, t in rows}
    # In a stage of generated code, that nothing interpreted is in.
    plan = made._jdf.queryExecution().executedPlan().toString()
    stage = [x for x in plan.split("\n") if "*(" in x and "Project" in x and "119]" in x]
    assert stage and "lambda" not in stage[0]


def test_no_lines(none):
    assert lines.dedup_lines(none).count() == 0


# Mixing


def test_mix_meets_its_weights(spark, none):
    rows = [(k, "w " * (1 + k % 9), "big" if k % 10 else f"small{k % 30}", 1) for k in range(3000)] + [(9000, None, "big", 1), (9001, " \n", "none", 1), (9002, "a b", None, 1), (5, "w w", "big", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    found = mixing.mix(df, entropy=0.9, repeats=None, block_tokens=500)
    got = defaultdict(int)
    taken = found.collect()
    for r in taken:
        got[r["source"]] += r["n_tokens"]
    total = sum(len((t or "").split()) for _, t, *_ in rows)
    weight = {r["source"]: r["weight"] for r in taken}
    for source, n in got.items():
        assert round(weight[source] * total) - 10 < n <= round(weight[source] * total) + 1
    shares = [w for w in weight.values() if w]
    assert -sum(w * math.log(w) for w in shares) >= 0.9 * math.log(4) - 1e-6
    copies = Counter((r["doc_id"], r["source"], r["copy"]) for r in taken)
    assert max(copies.values()) <= 2 and all(r["n_tokens"] > 0 for r in taken)
    assert mixing.mix(none).count() == 0


def test_a_tiny_source_is_repeated_no_more_than_the_limit(spark):
    rows = [(k, "w " * 9, "large") for k in range(2000)] + [(5000, "w", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df).where("source = 'tiny'").collect()
    assert sorted(r["copy"] for r in taken) == list(range(16))
    passes = mixing.mix(df, repeats=None).where("source = 'tiny'").collect()
    assert sorted(r["copy"] for r in passes) == list(range(len(passes))) and len(passes) > 2 * mixing.PASSES


def test_blocks_are_filled_in_order(spark):
    rows = [(k, "w " * (1 + k % 5), "a" if k % 4 else "b") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df, entropy=1.0, block_tokens=40).collect()
    tokens = Counter()
    for r in found:
        tokens[r["source"]] += r["n_tokens"]
    total = sum(1 + k % 5 for k in range(4000))
    assert all(total / 2 - 10 < n <= total / 2 + 1 for n in tokens.values())
    whole = Counter(r["block"] for r in mixing.mix(df, entropy=0.0, block_tokens=40).where("source = 'a'").collect())
    taken = Counter(r["block"] for r in found if r["source"] == "a")
    assert len(taken) > 50 and sum(taken[b] < whole[b] for b in taken) <= 1


def test_repeats_are_bounded(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    alpha = mixing.exponent(totals, repeats=3.0)
    weights = {r["source"]: r["weight"] for r in mixing.weights(totals, alpha).collect()}
    assert max(weights[s] * 1000 / t for s, t in (("a", 900), ("b", 90), ("c", 10))) == pytest.approx(3.0, abs=1e-5)
    assert mixing.exponent(totals, entropy=0.0) == 1.0
    assert mixing.exponent(totals, entropy=2.0) == 0.0
    assert sum(weights.values()) == pytest.approx(1)


# Nearest neighbours


def test_nearest_neighbours(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, 16))
    x[100:180] = x[100]
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0, 2.0]), (None, [1.0] * 16), (5, x[5].astype(np.float32).tolist()), (920, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("x")).withColumn("node", F.lit(0)).repartition(3)
    found = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, shard=250).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    e, hits = x.astype(np.float32).astype(np.float64), 0
    assert sorted(found) == list(range(0, 600, 20))
    for q, got in found.items():
        score = e @ e[q]
        order = [k for k in np.lexsort((np.arange(600), -score)) if k != q][:20]
        assert len(got) == 20 and all(s == pytest.approx(score[k], abs=1e-9) for k, s in got)
        assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)
        hits += len(set(order) & {k for k, _ in got})
    assert hits >= 0.9 * 20 * len(found)
    equal = [k for k, _ in found[120] if 100 <= k < 180]
    assert equal and equal == [k for k in range(100, 180) if k != 120][: len(equal)]


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = rows_of(ann.nearest(few, F.col("id") % 20 == 0))
    assert found == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0)]
    assert ann.nearest(few.limit(0), F.col("id") % 20 == 0).count() == 0
