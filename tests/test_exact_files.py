"""Files of an exact form: bytes as json.dumps gives them, many at once, nothing left of failed tasks."""

import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegauge.sources import exact, readers, sinks


@pytest.fixture()
def rows(spark):
    data = [(f"doc:ch{i % 7:02d}", f"Title {i} é", 'a "quoted"\nline   \U0001f642' if i % 3 else None, i, {"x": i / 4}) for i in range(40)]
    return data, spark.createDataFrame(data, "docid string, title string, text string, i long, m map<string,double>").repartition(5, "i")


def test_objects_arrays_and_lines_have_the_bytes_of_json_dumps(rows, tmp_path):
    data, df = rows
    one = df.where("i < 7")
    assert sinks.export_documents(one, str(tmp_path / "docs")) == 7
    for docid, title, text, _, _ in data[:7]:
        assert (tmp_path / "docs" / f"{docid}.json").read_text(encoding="utf-8") == json.dumps({"docid": docid, "title": title, "text": text}, indent=2, ensure_ascii=False)
    assert sorted(os.listdir(tmp_path / "docs")) == sorted(f"{d[0]}.json" for d in data[:7])
    assert sinks.export_json_array(df.orderBy(F.desc("i")), str(tmp_path / "all.json")) == 40
    want = [{k: v for k, v in zip(("docid", "title", "text", "i", "m"), r) if v is not None} for r in reversed(data)]
    assert (tmp_path / "all.json").read_text(encoding="utf-8") == json.dumps(want, indent=2, ensure_ascii=False)
    lines = df.select(F.col("docid").alias("strategy"), F.format_string("%03d", "i").alias("value"), "i")
    names = sinks.export_strategy_files(lines, f"file://{tmp_path}/txt", "qrels", ["i"])
    assert len(names) == 7 and (tmp_path / "txt" / "qrels_doc:ch03.txt").read_text() == "".join(f"{i:03d}\n" for i in range(3, 40, 7))
    assert not [n for _, folders, _ in os.walk(tmp_path) for n in folders if n.startswith("_")]


def test_empty_tables(rows, tmp_path):
    none = rows[1].where("false")
    assert sinks.export_json_array(none, str(tmp_path / "none.json")) == 0 and json.loads((tmp_path / "none.json").read_text()) == []
    assert sinks.export_documents(none, str(tmp_path / "docs")) == 0 and os.listdir(tmp_path / "docs") == []
    assert sinks.export_strategy_files(none.select(F.col("docid").alias("strategy"), F.col("title").alias("value")), str(tmp_path / "txt"), "run") == []


def test_a_failed_job_leaves_nothing_and_replaces_nothing(rows, tmp_path):
    (tmp_path / "doc:ch01.json").write_text("before")
    broken = rows[1].withColumn("value", F.when(F.col("i") == 39, "{not json").otherwise("{}"))
    with pytest.raises(Exception, match="JSON"):
        exact.write(broken, str(tmp_path), F.concat("docid", F.lit(".json")), F.col("value"), "object")
    assert os.listdir(tmp_path) == ["doc:ch01.json"] and (tmp_path / "doc:ch01.json").read_text() == "before"


def test_files_of_lost_attempts_do_not_count(tmp_path):
    batch = lambda *values: pa.RecordBatch.from_arrays([pa.array(["a", "a", "b"]), pa.array(values)], names=["file", "value"])
    writer = exact.ExactWriter(str(tmp_path), "lines", "job")

    def dies():
        yield batch("1", "2", "3")
        raise OSError("the executor is lost")

    with pytest.raises(OSError):
        writer.write(dies())
    speculative = writer.write(iter([batch("x", "y", "z")]))
    kept = writer.write(iter([batch("1", "2", "3")]))
    assert len(speculative.files) == 2 and len(os.listdir(tmp_path / "_job")) == 6
    writer.commit([kept, None])
    assert sorted(os.listdir(tmp_path)) == ["a", "b"] and (tmp_path / "a").read_text() == "1\n2\n" and (tmp_path / "b").read_text() == "3\n"


def test_small_files_are_read_many_a_task(spark, tmp_path):
    docs = spark.range(500).select(F.concat(F.lit("d:"), "id").alias("docid"), F.lit("t").alias("title"), F.repeat(F.lit("x"), 100).alias("text"))
    sinks.export_documents(docs, str(tmp_path))
    read = readers.json_documents(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() == 1 and sorted(r["docid"] for r in read.collect()) == sorted(f"d:{i}" for i in range(500))
    (tmp_path / "bad.json").write_text("{")
    some = spark.read.format("json_documents").option("path", str(tmp_path)).option("checked", "true").option("packed_bytes", 10_000).option("open_cost", 0).load()
    assert 5 < some.rdd.getNumPartitions() < 10 and some.where("load_error is not null").select("docid").collect()[0][0] == "bad" and some.count() == 501


def test_packing_keeps_every_file():
    sizes = [(str(i), s) for i, s in enumerate([5, 90, 1, 1, 1, 200, 3, 0])]
    got = readers.packed(sizes, 100, 1)
    assert [p for g in got for p in g] == [p for p, _ in sizes] and got == [["0", "1", "2"], ["3", "4"], ["5"], ["6", "7"]]
