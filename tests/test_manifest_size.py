"""Chunks hold all texts several times over: on their way to the manifests and back they take little disk."""

import os

from pyspark.sql import functions as F

from lodegauge.operators import chunking
from lodegauge.plans import transport
from lodegauge.sources import readers, scratch, sinks


def _docs(spark):
    data = [(str(i), " ".join(f"Word{i * k % 97} in “document”  {i}, line {k}." for k in range(60)) if i % 9 else None) for i in range(200)]
    return spark.createDataFrame(data, "docid string, text string").repartition(3)


def _shuffled(spark) -> int:
    """Shuffles that were ever planned in this session."""
    return spark.sparkContext._jsc.sc().newShuffleId()


def test_manifests_are_written_where_chunks_are_made(spark, tmp_path):
    docs = scratch.written(_docs(spark), "docs")
    chunks = chunking.chunk_all(docs)
    want = sorted(map(str, chunks.select("strategy", "docid", "chunk_id", "start", "end", "text").collect()))
    setting = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    for codec, ending in (("none", ".json"), ("gzip", ".json.gz")):
        path, before = str(tmp_path / codec), _shuffled(spark)
        sinks.chunk_manifests(chunks, path, codec)
        assert _shuffled(spark) == before + 1  # the one that _shuffled itself takes
        files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
        assert files and all(f.endswith(ending) for f in files)
        back = readers.json_lines(spark, path, "original_doc_id string, chunk_id string, start long, `end` long, text string, strategy string")
        assert sorted(map(str, back.select("strategy", F.col("original_doc_id").alias("docid"), "chunk_id", "start", "end", "text").collect())) == want
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == setting


def test_more_strategies_than_are_written_side_by_side(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "_SIDE_BY_SIDE", 2)
    monkeypatch.setattr(sinks, "_FILE_ROWS", 50)
    chunks = chunking.chunk_all(_docs(spark))
    sinks.chunk_manifests(chunks, str(tmp_path / "m"), "gzip")
    got = spark.read.schema("chunk_id string, strategy string").json(str(tmp_path / "m"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.select("chunk_id", "strategy").collect()))
    assert max(r["count"] for r in got.groupBy(F.input_file_name()).count().collect()) <= 50


def test_the_round_trip_takes_less_than_the_texts(spark, monkeypatch):
    paths, new = [], scratch.new_path
    monkeypatch.setattr(scratch, "new_path", lambda *a: paths.append(new(*a)) or paths[-1])
    docs = scratch.written(_docs(spark), "docs")
    paths.clear()
    back = transport._chunks_back(spark, docs)
    rows = back.collect()
    assert len(rows) > 1000 and not any(r["corrupt"] for r in rows)
    [folder] = [p.removeprefix("file://") for p in paths]
    size = sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names if f.startswith("part-"))
    assert size < docs.agg(F.sum(F.length("text"))).first()[0]
