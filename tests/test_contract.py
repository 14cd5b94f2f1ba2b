"""Every registered query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodegauge.plans import contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return str(round(v, 6) + 0.0)
    if hasattr(v, "item"):
        return cell(v.item())
    return str(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(contract.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    got, want = contract.QUERIES[name](spark, SF).toPandas(), db.sql(contract.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_optional_operators():
    root = os.path.dirname(os.path.dirname(contract.__file__))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert "lodegauge.llm" not in text and "corpus_pipeline" not in text, f
