"""What questions and answers cost grows with the texts, not with their squares or with the number of questions."""

import time

from pyspark.sql import functions as F

from lodegauge.operators import annotate, replies, spans
from lodegauge.sources import scratch


def test_a_text_without_end_marks_is_read_once():
    begin = time.time()
    [reply] = annotate.offline_generator()(["x\nDocument:\nFirst one. Second? " + "word " * 40_000])
    assert reply == '{"questions": ["What is said by: First one.?", "What is said by: Second??"]}'
    assert time.time() - begin < 10


def test_prompts_are_not_written_down(spark, tmp_path, monkeypatch):
    seen, whole = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, label: seen.append(df.columns) or whole(df, label))
    rows = spark.createDataFrame([(i, f"p{i % 3}") for i in range(9)], "id int, prompt string")
    got = replies.ask(rows, lambda: lambda ps: [p.upper() for p in ps], str(tmp_path / "store"), flush=1)
    assert {r["id"]: r["reply"] for r in got.collect()} == {i: f"P{i % 3}" for i in range(9)}
    assert seen and not any("prompt" in c for c in seen)
    files = [f.name for f in (tmp_path / "store").iterdir() if f.name.endswith(".parquet")]
    assert len(files) <= 3 and len({f.rsplit("-", 1)[0] for f in files}) == len(files)


def test_located_is_locate_span_of_the_join(spark):
    texts = spark.createDataFrame([("a", "The İstanbul ΟΔΟΣ road, a_b and so on."), ("b", None), ("c", "x y z"), ("a", "so on")], "docid string, doc_text string")
    data = [("a", "so on", 1), ("a", "“οδος”...", 2), ("a", "a_b", 3), ("b", "x", 4), ("c", "Y", 5), ("c", None, 6), ("d", "x", 7), (None, "x", 8), ("c", "qq", 9)]
    rows = spark.createDataFrame(data, "docid string, snippet string, n int")
    for snap in (True, False):
        want = spans.locate_span(rows.join(texts.where("doc_text is not null"), "docid"), snap=snap).drop("doc_text")
        got = spans.located(rows, texts, snap=snap).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert got.where("span_text is not null").count() >= 4
