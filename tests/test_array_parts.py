"""Annotators' arrays are dealt to files of a bounded number of rows."""

from pyspark.sql import functions as F

from lodegauge.plans import transport


def test_many_annotations_are_many_files(spark, monkeypatch):
    monkeypatch.setattr(transport, "_ROWS", 50)
    seen, write = [], transport.exact.write
    monkeypatch.setattr(transport.exact, "write", lambda rows, folder, *a: seen.append(folder) or write(rows, folder, *a))
    rows = spark.range(400).select(
        F.concat(F.lit("q"), F.col("id") % 100).alias("qid"), F.lit("d").alias("docid"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"),
        F.lit("t").alias("text"), F.lit("AND").alias("logic"), F.when(F.col("id") % 2 == 0, "sme.1").otherwise("sme2").alias("sme_id"), F.col("id").alias("src_ord"))
    back = transport._annotations_back(spark, rows)
    assert sorted((r["sme_id"], r["start"]) for r in back.collect()) == sorted(("sme2" if i % 2 else "sme.1", i) for i in range(400))
    assert len(transport.exact.names(seen[0])) > 4
