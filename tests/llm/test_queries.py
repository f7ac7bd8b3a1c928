"""The registered queries over the smallest tables, and the pipeline's stages, against brute force or SQL."""

import base64
import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loopscope.llm import langid, mixing
from loopscope.llm import queries as llm
from tests.llm.test_operators import SCHEMA, brute_fingerprint, brute_lines, brute_removal, joined, rows_of
from tests.llm.test_whole import brute_similar

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


@pytest.fixture(scope="module")
def documents():
    return duckdb.connect().execute(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    return llm.queries()[name](spark, SF)


def test_quality_on_held_out_rows(spark):
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    rows = run(spark, "op1_quality").collect()
    known = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 200 and sum(r["predicted"] == labels[r["doc_id"]] for r in known) >= 0.9 * len(known)


def test_warc(spark):
    pages = duckdb.connect().execute(f"SELECT page_id, coalesce(html, '') FROM '{SF}/pages.parquet'").fetchall()
    largest = {}
    for i, h in pages:
        largest[h] = max(i, largest.get(h, i))
    expected = [(i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if largest[h] == i else "revisit", None if largest[h] == i else largest[h]) for i, h in pages]
    assert rows_of(run(spark, "op2_warc")) == sorted(expected, key=repr)


def test_substring(spark, documents):
    assert rows_of(run(spark, "op3_substring_dedup")) == brute_removal(documents)


def test_simhash(spark, documents):
    own = [(i, brute_fingerprint(t, 3)) for i, t, *_ in documents]
    roots = joined([(a, b) for a, x in own for b, y in own if a < b and (x ^ y).bit_count() <= 2], {i for i, _ in own})
    assert rows_of(run(spark, "op4_simhash")) == sorted(((i, f"{x:016x}", roots[i]) for i, x in own), key=repr)


def test_tokens(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    counts = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t, *_ in documents]
    assert rows_of(run(spark, "op6_token_counts")) == sorted(((*c, c[2] > 512) for c in counts), key=repr)


def test_languages_on_held_out_rows(spark, documents):
    lang = {i: x for i, _, x, *_ in documents}
    held = [r for r in run(spark, "op7_language_id").collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_nearest_neighbours(spark):
    rows = duckdb.connect().execute(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = {}
    for r in run(spark, "op10_nearest").collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        hits += len({*found[q].values()} & {k for k in ids[np.lexsort((ids, -score))] if k != q and k in set(ids[np.lexsort((ids, -score))][:21])})
    assert hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("name", ["op5_decontamination", "op9_mixing"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert rows_of(run(spark, name).select(*columns)) == sorted(expected.fetchall(), key=repr)


def brute_language(documents):
    """The rows that language ID keeps, by profiles counted with dictionaries."""

    def grams(text):
        words = "_".join(["", *re.findall(r"[^\W\d_]+", text.lower()), ""])
        return Counter(words[k : k + n] for n in langid.LENGTHS for k in range(len(words) - n + 1) if words[k : k + n] != "_")

    return [r for r in documents if r[1] is not None and grams(r[1])]


def test_stages_one_by_one(spark, documents):
    """Each stage on what the one before it kept, held against brute force."""
    extra = [(900, None, None, "s", 0), (901, "12 !! --", "en", "s", 8), (902, documents[0][1], "fr", "s", 1), (903, documents[1][1] + " and some", None, None, 1)]
    rows = [r for r in documents if len(r[1]) < 4000][:60] + extra
    docs = spark.createDataFrame(rows, SCHEMA)
    first = corpus_pipeline.language_id(spark, docs, SF)
    kept = [tuple(r) for r in first.collect()]
    assert first.columns == docs.columns
    assert sorted(r[0] for r in kept) == sorted(r[0] for r in brute_language(rows)) and all(r[2] for r in kept)

    docs = spark.createDataFrame(kept, SCHEMA)
    gone = brute_lines([r[:2] for r in kept])
    left = {}
    for i, t, *_ in kept:
        lines = [x for p, x in enumerate(t.split("\n")) if (i, p) not in gone]
        if len(lines) == t.count("\n") + 1 or re.search(r"[^\x00-\x20]", "\n".join(lines)):
            left[i] = "\n".join(lines)
    second = corpus_pipeline.line_dedup(spark, docs, SF)
    kept = [tuple(r) for r in second.collect()]
    assert second.columns == docs.columns and {r[0]: r[1] for r in kept} == left and all(r[4] == len(r[1]) for r in kept)

    rows = kept + [(905, kept[0][1], "en", "s", 1), (907, kept[2][1] + " more", "en", "s", 1), (None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    roots = brute_similar(rows, 5)
    third = corpus_pipeline.near_dedup(spark, docs, SF)
    assert {r["doc_id"] for r in third.collect()} == {i for i in roots if roots[i] == i} | {None}

    items = duckdb.connect().execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    docs = spark.createDataFrame([tuple(r) for r in third.collect()] + [(906, "Before. " + items[0][0] + " after", "en", "s", 1)], SCHEMA)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    runs = lambda t: {tuple(w[k : k + 5]) for w in [words(t)] for k in range(len(w) - 4)}
    own = [runs(t) for (t,) in items]
    clean = {r["doc_id"] for r in docs.collect() if not any(x and len(x & runs(r["text"])) >= 0.8 * len(x) for x in own)}
    fourth = corpus_pipeline.decontaminate(spark, docs, SF)
    assert {r["doc_id"] for r in fourth.collect()} == clean and 906 not in clean

    con = duckdb.connect()
    documents = fourth.toPandas()  # noqa: F841  read by the SQL
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    last = corpus_pipeline.mixing_to_weights(spark, fourth, SF)
    expected = con.execute(f"SELECT CAST(doc_id AS BIGINT), source, copy, block, n_tokens, weight FROM ({mixing.ORACLE_SQL})").fetchall()
    plain = lambda rows: sorted(((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in rows), key=repr)
    assert plain(map(tuple, last.collect())) == plain(expected)


def test_run_applies_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(docs)
    assert docs.where(F.col("n_tokens") > 0).count() > 50


def test_no_documents(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_columns_of_any_name(spark, documents):
    """Names that stages use within themselves, rows without an id and rows of one id."""
    item = duckdb.connect().execute(f"SELECT text FROM '{SF}/benchmark.parquet' LIMIT 1").fetchone()[0]
    rows = [r for r in documents if len(r[1]) < 1500][:25] + [(None, "Here: " + item, "en", "s", 1), (7000, "Here: " + item, "en", "s", 1), (7000, documents[0][1][:300] + " of another row", "en", "s", 1)]
    names = ("score", "_lines", "gone", "leaked", "key", "row", "c0", "lang_pred", "n_removed", "root", "predicted")
    plain = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, plain.withColumns({c: F.lit("x") for c in names}), SF)
        assert found.columns == [*plain.columns, *names]
        assert rows_of(found.select(plain.columns)) == rows_of(stage(spark, plain, SF))
    left = corpus_pipeline.decontaminate(spark, plain, SF).collect()
    assert not any(item in r["text"] for r in left) and sum(r["doc_id"] == 7000 for r in left) == 1
    mixed = corpus_pipeline.mixing_to_weights(spark, plain.withColumn("copy", F.lit("x")), SF)
    assert rows_of(mixed) == rows_of(corpus_pipeline.mixing_to_weights(spark, plain, SF))
