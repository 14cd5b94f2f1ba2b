"""Texts are read and normalized once a pass, whatever is made of them."""

from pyspark.sql import functions as F

from lodegauge.functions import text as tx
from lodegauge.operators import alignment, chunking


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_all_strategies_share_one_pass(spark):
    docs = spark.createDataFrame([("a", "One two. Three“four”   five!"), ("b", None), ("c", " \x1c ")], "docid string, text string")
    got = chunking.chunk_all(docs)
    assert plan(got).count("MapInArrow") == 1 and "regexp_replace" not in plan(got)
    alone = [r for k, f in chunking.STRATEGIES.items() for r in f(docs).withColumn("strategy", F.lit(k)).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alone)) and alone
    assert sorted(got.drop("text").collect()) == sorted(chunking.chunk_all(docs, texts=False).collect())


def test_normalized_is_the_expression_and_is_computed_once(spark):
    odd = "".join(c for c in map(chr, range(0x3100)) if c.isspace())
    texts = [None, "", " ", odd, f"a{odd}b", "a‘b’c“d”e—f–g", *(f"x{c}y {c}" for c in odd), "é  Ω​﻿ z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    want = {r[0]: r[1] for r in df.select("i", tx.normalize_offsets(F.col("text"))).collect()}
    got = tx.normalized(df)
    assert {r[0]: r[1] for r in got.collect()} == want
    assert plan(got.withColumn("n", F.length("text")).where("n > 0").where("text <> 'x'")).count("MapInArrow") == 1


def test_token_windows_of_texts_beyond_ascii(spark):
    texts = ["a b " * 300 + "ü", "naïve_1 x-y, " * 90, "é" * 700, "1é ² " * 200]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "docid string, text string")
    import regex

    for size, stride in ((512, 128), (6, 4), (4, 4), (3, 7)):
        want = []
        for d, t in enumerate(texts):
            t = tx.plain_text(t)
            at = [m.span() for m in regex.finditer(chunking.TOKEN, t)]
            for i in range(0, len(at), stride):
                s = at[i][0] + (t[at[i][0]] == " ")
                want.append((str(d), s, at[min(i + size, len(at)) - 1][1]))
                if i + size >= len(at):
                    break
        assert sorted((r["docid"], r["start"], r["end"]) for r in chunking.token_windows(docs, size, stride).collect()) == sorted(want)


def test_thresholds_name_a_coverage_once(spark):
    sp = spark.createDataFrame([("q", "d", 0, 9), ("q", "d", 3, 7)], "qid string, docid string, start int, `end` int")
    ch = spark.createDataFrame([("d", "c", 0, 5), ("d", "e", 5, 12)], "docid string, chunk_id string, start int, `end` int")
    grid = alignment.threshold_grid(alignment.overlapping_pairs(sp, ch, 4))
    assert plan(grid).count("greatest(") < 30
    rows = {(r["t_span"], r["t_chunk"]): r["n"] for r in grid.collect()}
    pairs = [(min(e, ce) - max(s, cs), e - s, ce - cs) for s, e in ((0, 9), (3, 7)) for cs, ce in ((0, 5), (5, 12)) if min(e, ce) > max(s, cs)]
    assert rows == {(a, b): sum(x / n >= a and x / m >= b for x, n, m in pairs) for a in alignment.SPAN_GRID for b in alignment.CHUNK_GRID}
