"""Operators that have to find all there is, held against brute force over all pairs."""

import os
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopscope.llm import ann, groups, langid, shingles, simhash
from tests.llm.test_operators import SCHEMA, joined

SF = "/root/testdata/sf0.001"


def near_copies():
    """Texts with copies that have some words replaced, a group of many near copies, and texts that quote one passage."""
    draw = random.Random(3)
    text = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    rows, middle, quote = [], text(150), text(40)
    for k in range(40):
        words = text(draw.randint(3, 200))
        rows.append(words)
        for _ in range(k % 4):
            other = list(words)
            for _ in range(draw.randint(1, 3)):
                other[draw.randrange(len(other))] = "other"
            rows.append(other)
    for k in range(60):
        other = list(middle)
        for _ in range(draw.randint(1, 3)):
            other[draw.randrange(150)] = f"x{k}"
        rows.append(other)
        rows.append(quote + text(draw.randint(0, 12)))
    rows += [rows[5], [], []]
    return [(k, " ".join(words), "en", "s", 1) for k, words in enumerate(rows)] + [(3, "a second text of one id", "en", "s", 1), (None, "no id", "en", "s", 1)]


def brute_similar(rows, n):
    own = []
    for i, t, *_ in rows:
        words = t.split()
        if i is not None:
            own.append((i, {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}))
    pairs = [(a, b) for k, (a, x) in enumerate(own) for b, y in own[k + 1 :] if 5 * len(x & y) >= 4 * len(x | y)]
    return joined(pairs, {i for i, _ in own})


@pytest.mark.parametrize("paired", [4, 32])
def test_near_copies_are_found_at_shingle_similarity(spark, monkeypatch, paired):
    import corpus_pipeline

    monkeypatch.setattr(groups, "PAIRED", paired)
    rows = near_copies()
    docs = spark.createDataFrame(rows, SCHEMA)
    roots = brute_similar(rows, shingles.SHINGLE)
    found = dict(map(tuple, simhash.similar_documents(docs).collect()))
    # No two documents are grouped that no chain of similar ones joins.
    assert all(roots[i] == roots[root] for i, root in found.items())
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i in roots if found.get(i, i) == i} | {None}
    # Fingerprints are drawn, so that some copies that differ much are missed.
    copies = [i for i in roots if roots[i] != i]
    recall = sum(i not in kept for i in copies) / len(copies)
    print("recall", recall, len(copies))
    assert recall >= 0.9 and len(copies) > 80


@pytest.mark.parametrize(("changed", "least"), [(0.01, 0.99), (0.02, 0.95)])
def test_copies_with_replaced_words_are_found(spark, changed, least):
    draw, rows = random.Random(11), []
    for k in range(300):
        words = [f"w{draw.randrange(5000)}" for _ in range(draw.randint(100, 400))]
        other = list(words)
        for at in draw.sample(range(len(words)), int(changed * len(words))):
            other[at] = f"new{draw.randrange(1000)}"
        rows += [(2 * k, " ".join(words), "en", "s", 1), (2 * k + 1, " ".join(other), "en", "s", 1)]
    roots = brute_similar(rows, shingles.SHINGLE)
    found = dict(map(tuple, simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()))
    copies = [i for i in roots if roots[i] != i]
    recall = sum(found.get(i, i) == roots[i] for i in copies) / len(copies)
    print("recall", recall, len(copies))
    assert recall >= least and len(copies) > 200


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")
def test_gibberish_and_unlearnt_languages_are_rejected(spark):
    import corpus_pipeline

    draw = random.Random(1)
    junk = [" ".join("".join(draw.choice(string.ascii_lowercase) for _ in range(draw.randint(2, 9))) for _ in range(n)) for n in (10, 50, 300, 3000)]
    junk += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."]
    clean = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in clean.select("doc_id").collect()}
    docs = clean.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(10_000 + k, t, None, "s", len(t)) for k, t in enumerate(junk)], SCHEMA))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).select("doc_id").collect()}
    assert kept == ids


@pytest.mark.parametrize("few", [50, 100_000])
def test_language_stage_learns_from_all_documents(spark, monkeypatch, few):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "SORTED", few, raising=False)
    draw = random.Random(6)
    words = {lang: ["".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(300)] for lang, letters in (("en", "abcdefgh"), ("fr", "efghijkl"))}
    rows = [(i, " ".join(draw.choice(words[lang]) for _ in range(3)), lang, "s", 1) for i in range(33_000) for lang in [draw.choice(["en", "fr"])]]
    docs = spark.createDataFrame(rows, SCHEMA)
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    every, fit, made = langid.fit(docs, part != 1, rows=1 << 40), langid.fit, []
    monkeypatch.setattr(langid, "fit", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    corpus_pipeline.language_id(spark, docs, "")
    assert np.array_equal(made[0].known, every.known) and np.array_equal(made[0].ranks, every.ranks)
    held = docs.where(part == 1)
    scores = [r["score"] for r in langid.predict(held, every, keep=("lang",)).collect() if r["lang"] == r["lang_pred"]]
    assert len(scores) > 10_000 and corpus_pipeline.least_score(held, every) == pytest.approx(corpus_pipeline.SHARE * np.quantile(scores, corpus_pipeline.SURE), rel=1e-12)


def test_nearest_on_clusters_over_several_shards(spark):
    draw = np.random.default_rng(5)
    middle = draw.normal(size=(100, 32))
    x = np.repeat(middle, 120, axis=0) + 0.1 * draw.normal(size=(12_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x[draw.permutation(len(x))]
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest(vectors, F.col("id") % 20 == 0, shard=6000).collect()
    hits = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len({r["vec_id"] for r in found if r["query_id"] == q} & set(np.argsort(-score)[:20].tolist()))
    recall = hits / (20 * len(range(0, len(x), 20)))
    print("recall", recall)
    assert recall >= 0.9


def recall_of(spark, x, every=80, **options):
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(vectors, F.col("id") % every == 0, **options).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, len(x), every):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    return hits / (20 * len(found))


@pytest.mark.parametrize("norms", ["gaussian", "one", "skewed"])
def test_nearest_at_any_norms(spark, norms):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(16_000, 64))
    if norms == "one":
        x[4321] *= 1000
    if norms == "skewed":
        x *= np.exp(draw.normal(size=(16_000, 1)))
    recall = recall_of(spark, x)
    print("recall", norms, recall)
    assert recall >= 0.9
