"""Every query of the catalogue against its SQL on the smallest tables."""

import os
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

from loopscope import queries as catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]

    def text(v):
        if pd.isna(v):
            return "NULL"
        # Whole numbers with nulls among them come as floats.
        return f"{float(v):.12g}" if isinstance(v, bool | np.bool_ | int | float | np.integer | np.floating) else str(v)

    return sorted(tuple(map(text, r)) for r in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, db, name):
    found = catalogue.queries()[name](spark, SF).toPandas()
    if name not in catalogue.oracle_sql():
        assert len(found.columns)
        return
    expected = db.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found) == plain(expected)


def test_entry_needs_no_training_data_operators(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    import __spark_entry__ as bare

    assert bare.llm is None and set(bare.queries()) == set(catalogue.queries())


def test_reduction_stays_in_the_jvm(spark):
    plan = catalogue.reduce_paths(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
