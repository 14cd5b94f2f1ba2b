"""Repeated labels and keys, and extra columns named as the operators name their own."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodegauge.llm import jaccard_join, mixing, quality_rules

WORDS = "the of and to in that is was he for it with".split()


def test_repeated_labels_and_texts_certify_nothing(spark):
    noisy = " ".join(w + "##" for w in WORDS)
    rows = [(1, " ".join(WORDS), "en"), (2, noisy, "en"), (3, noisy + " x", "en")] + [(10 + i, " ".join(WORDS), "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)] * 300 + [(10 + i, 1) for i in range(300)] + [(2, 0)], "doc_id long, quality int")
    assert all(r["kept"] for r in quality_rules.quality_rules(df, labels).collect())
    told_apart = df.withColumn("text", F.when(F.col("doc_id") >= 10, F.concat("text", F.lit(" n"), "doc_id")).otherwise(F.col("text")))
    assert {r["doc_id"] for r in quality_rules.quality_rules(told_apart, labels).where("not kept").collect()} == {2, 3}
    good_as_well = labels.union(spark.createDataFrame([(2, 1)], labels.schema))
    assert all(r["kept"] for r in quality_rules.quality_rules(told_apart, good_as_well).collect())


def test_strata_that_cannot_pass_alone_take_no_share(spark):
    rows = [(i, " ".join(WORDS) + f" n{i}", "en", 1) for i in range(150)] + [(1000 + i, " ".join(w + "##" for w in WORDS) + f" n{i}", "en", 0) for i in range(5)]
    rows += [(2000 + i, " ".join(WORDS) + f" m{i}", f"x{i % 9}", 1) for i in range(90)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df, labels).collect()}
    assert kept == {r[0]: r[3] == 1 for r in rows}


@pytest.fixture(scope="module")
def repeated(spark):
    rows = [(7, f"one two {i % 9} " * 3, "a") for i in range(40)] + [(i, f"word {i} " * 4, "b") for i in range(100, 140)] + [(None, "x y", None)] * 3 + [(8, None, "a"), (8, "", "a")]
    odd = ["__at", "__key", "__mix_source", "__gone", "__kind", "__piece", "__place", "__c0", "__id", "a.b", "place"]
    return spark.createDataFrame([(*r, *range(len(odd))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in odd)).repartition(3)


def test_mixing_repeated_keys_is_what_its_sql_says(repeated):
    con = duckdb.connect()
    con.register("given", repeated.select("doc_id", "text", "source").toPandas())
    con.sql("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, source FROM given")
    want = sorted(map(str, con.sql(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.ORACLE})").fetchall()))
    got = mixing.mixing_report(repeated).select("doc_id", "size", "source_size", F.round("target", 6), "taken").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_extra_columns_of_any_name_are_kept(repeated):
    mixed = mixing.mix_documents(repeated)
    assert mixed.columns == repeated.columns
    known = {str(r) for r in repeated.collect()}
    rows = [str(r) for r in mixed.collect()]
    assert rows and set(rows) <= known
    taken = mixing.mixing_report(repeated).where("size > 0").agg(F.sum(F.expr("taken div size"))).first()[0]
    assert mixed.where("trim(text) <> ''").count() == taken


def test_one_of_each_keeps_columns_of_any_name(spark, repeated):
    apart = repeated.where("doc_id >= 100").union(repeated.where("doc_id = 110").withColumn("doc_id", F.lit(999).cast("long")))
    kept = jaccard_join.one_of_each(apart, 5, 80)
    assert kept.columns == repeated.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(100, 140))
    assert jaccard_join.one_of_each(repeated, 5, 80).columns == repeated.columns
