"""Every stage of the pipeline on its own input, and the registered queries on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from lodegauge.llm import queries
from lodegauge.sources import scratch

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "jaccard_join", "mixing", "piece_sampling"]
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.written(stage(spark, docs, SF), "stage")
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert set(ids) <= set(before)
        if name == "quality_rules":
            verdict = queries.QUERIES["op1_quality_rules"](spark, SF)
            assert sorted(ids) == sorted(r["doc_id"] for r in verdict.where("kept").collect())
        if name == "jaccard_join":
            from lodegauge.llm.jaccard_join import jaccard_components

            found = jaccard_components(docs, 5, 80).collect()
            assert sorted(ids) == sorted({r["component_id"] for r in found})
        if name == "mixing":
            from lodegauge.llm.mixing import mixing_report

            assert len(ids) == sum(r["taken"] // r["size"] for r in mixing_report(docs).where("size > 0").collect())
        if name != "piece_sampling":
            assert out.columns == columns and all(r["text"] == before[r["doc_id"]] for r in out.select("doc_id", "text").collect())
        else:
            assert out.where("not lossless").count() == 0 and len(ids) == sizes[-1]
        sizes.append(len(ids))
        docs = out
    assert sizes[-1] > 0


def test_stages_of_nothing(spark, tmp_path):
    """Empty tables give empty tables with the same columns; the whole run, too."""
    names = ("documents", "labels")
    for t in names:
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "piece_sampling" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_odd_rows(spark, tmp_path):
    """Null keys, sources, languages and texts, repeated rows and extra columns through all stages."""
    good = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 300 and 900").orderBy("doc_id").limit(12)
    text = [r["text"] for r in good.collect()]
    rows = [(i, t, "en", "a", 1, "x") for i, t in enumerate(text[:6])] + [(0, text[0], "en", "a", 1, "x")] * 2
    rows += [(None, text[6], None, None, 1, None), (None, text[6], None, None, 1, None), (None, None, "en", "a", 0, "x"), (50, None, None, "b", None, "x"), (51, "", "en", None, 0, "x")]
    rows += [(60, text[7], "en", "b", 1, "x"), (60, text[8], "en", "b", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = scratch.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(kept) == len(set(kept)) and {k for k in kept if k[1] is None or not k[1]} == set()
    assert set(kept) <= {(r[0], r[1]) for r in rows} and (None, text[6]) in kept and {(60, text[7]), (60, text[8])} <= set(kept)
    assert corpus_pipeline.run(spark, str(tmp_path)).where("not lossless").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_pieces", "ids", "lossless"] and out.count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "labels", "embeddings", "pages", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(queries.ORACLE_SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda d: sorted(tuple(x if isinstance(x, str) else round(float(x), 6) for x in r) for r in d[columns].itertuples(index=False))
        assert rows(got) == rows(want)
