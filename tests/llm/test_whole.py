"""Jobs that operators once did in part, done whole."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodegauge.llm import quality_rules, queries, topk

WORDS = [f"{a}{b}" for a in ("ta", "ro", "mi", "ke") for b in ("lon", "ver", "sit", "dan", "pel")]


def test_strata_of_a_few_hundred_labels_get_rules(spark):
    """Per stratum: good and bad documents by their share of words with a symbol; 'zz' is good with a few symbols too
    often for the strict cutoff, 'yy' has too few labels."""
    rows = []

    def add(lang, n, symbols, quality):
        for _ in range(n):
            i = len(rows)
            rows.append((i, " ".join(w + "#" * (j < symbols) for j, w in enumerate(WORDS)) + f" n{i}", lang, quality))

    for lang, n in (("de", 300), ("fr", 320), ("zz", 400), ("yy", 216)):
        add(lang, n, 0, 1)
        add(lang, 12, 16, 0)
    add("zz", 30, 4, 1)
    add("zz", 9, 4, 0)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    features = quality_rules.counts(df).where("not base_failed")
    assert features.count() == len(rows)
    cuts = {(r["lang"], r["rule"]): r["cutoff"] for r in quality_rules.calibrate(features, labels).collect()}
    assert cuts == {(x, "symbols"): 0.75 for x in ("de", "fr", "zz")}
    assert 0.98**216 > 0.05 / 4 >= 0.98**217
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df, labels).collect()}
    assert all(kept[i] == (q == 1 or lang == "yy" or t.count("#") == 4) for i, t, lang, q in rows)


def test_rules_share_the_risk_of_a_stratum(spark):
    """Two rules that lose 4 good documents of 600 each, and would pass alone, do not pass together."""
    n = 600
    tail = lambda k: sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1))
    assert tail(4) <= 0.05 < tail(8)
    good = [(i, 1, 1 if i < 4 else 0, 30 if 4 <= i < 8 else 0) for i in range(n)]
    bad = [(n + i, 0, 1, 0) for i in range(9)] + [(2 * n + i, 0, 0, 30) for i in range(5)]
    df = spark.createDataFrame([(i, None, s * 25, c) for i, _, s, c in good + bad], "doc_id long, lang string, n_symbols long, n_capitals long")
    zero = [F.lit(x).cast("long").alias(k) for k, x in {"n_words": 10, "word_chars": 40, "n_dup_lines": 0, "n_lines": 1, "n_repeat_words": 0, "n_exclaims": 0}.items()]
    features = df.select("*", *zero, F.lit(False).alias("base_failed"))
    labels = spark.createDataFrame([(i, q) for i, q, _, _ in good + bad], "doc_id long, quality int")
    assert [tuple(r) for r in quality_rules.calibrate(features, labels).collect()] == [(None, "symbols", 2.0)]


def test_repeated_query_rows_have_k_results_each(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [i / 16, 1 - i / 16]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 3).collect()))
    first, last = [(0, r, 9 - r, 4096 * (9 - r)) for r in (1, 2, 3)], [(0, r, r, 4096 * (16 - r)) for r in (1, 2, 3)]
    assert got == sorted(first + first + last)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_certified_cutoffs_reject_documents_in_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE NOT kept AND NOT base_failed").fetchall()}
    got = {r["doc_id"] for r in queries.op1_quality_rules(spark, sf).where("not kept and not base_failed").collect()}
    assert got == want and len(got) > 5
