"""Spans merged as a stream give what merge_spans gives; late rows are told; state ends with its questions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodegauge.operators import spans
from lodegauge.streaming import merging, pipelines

SCHEMA = "qid string, docid string, start long, `end` long, logic string, `group` string, sme_id string, src_ord long, at timestamp"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture()
def folder(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go(files=1):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
        merging.run(merging.merged(stream, late=300, hold=600), str(tmp_path / "state"), str(tmp_path / "out"))
        rows = spark.read.schema(merging.OUTPUT).parquet(str(tmp_path / "out"))
        return sorted((tuple(r) for r in rows.collect()), key=str)

    def state():
        return spark.read.format("statestore").option("stateVarName", "spans").load(str(tmp_path / "state")).count()

    return put, go, state


def mark(minutes):
    return [(*[None] * 8, at(minutes))]


def test_questions_merge_as_a_whole_and_leave_the_state(spark, folder):
    put, go, state = folder
    rng = random.Random(3)
    rows = [(f"q{rng.randrange(12)}", rng.choice(["d1", "d2"]), s := rng.randrange(0, 200), s + rng.choice([0, 1, 20, 30, 60]), rng.choice(["AND", "OR"]), rng.choice([None, "g2"]), rng.choice(["a", "b", None]), i, at(i / 100)) for i in range(400)]
    for k in range(0, 400, 100):
        put(rows[k : k + 100])
    assert go() == [] and state() == sum(r[2] < r[3] for r in rows)
    put(mark(60))
    got = go()
    want = spans._fold(spark.createDataFrame(rows, SCHEMA)).where("not clash").select("qid", "docid", "start", "end", "logic", "grp", "by", F.lit(False))
    assert got == sorted((tuple(r) for r in want.collect()), key=str) and state() == 0
    assert go() == got


def test_late_rows_are_told_and_merge_with_nothing(folder):
    put, go, state = folder
    span = lambda q, minute, who: (q, "d", 0, 10, "AND", None, who, 0, at(minute))
    put([span("q1", 0, "a"), span("q2", 14, "a")])
    go()
    put([span("q1", 2, "b"), span("q2", 10, "b")])  # five minutes behind fourteen: the first is too late
    put(mark(40))
    assert go() == [("q1", "d", 0, 10, "AND", "g1", "a", False), ("q1", "d", 0, 10, "AND", "g1", "b", True), ("q2", "d", 0, 10, "AND", "g1", "a+b", False)]
    assert state() == 0
    put([span("q1", 50, "c")])  # a question may come again
    put(mark(90))
    assert ("q1", "d", 0, 10, "AND", "g1", "c", False) in go() and state() == 0


def test_windows_are_counted_in_updates_and_close(spark, tmp_path):
    rows = [(at(i * 7), "a" if i % 3 else "b", i / 4) for i in range(200)]
    schema = "ts timestamp, event_type string, value double"
    for k in range(0, 200, 50):
        spark.createDataFrame(rows[k : k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = pipelines.event_counts(stream).select("window.start", "event_type", "n", "value")
    pipelines.run_updates(counts, str(tmp_path / "state"), str(tmp_path / "out"))
    got = pipelines.latest(spark, str(tmp_path / "out"), "start timestamp, event_type string, n long, value double", ["start", "event_type"])
    want = pipelines.event_counts(spark.createDataFrame(rows, schema)).select("window.start", "event_type", "n", "value")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.read.format("statestore").load(str(tmp_path / "state")).count() < want.count() / 3


def test_questions_share_their_state_and_close_one_by_one(folder, monkeypatch):
    """Questions of one slot: those that are due go, the others stay, grow and go later; messages grow with slots, not questions."""
    monkeypatch.setattr(merging, "SLOTS", 2)
    monkeypatch.setattr(merging, "SENT", 3)
    put, go, state = folder
    span = lambda k, minute, who: (f"q{k}", "d", 0, 10, "AND", None, who, 0, at(minute))
    put([span(k, k / 10, "a") for k in range(40)])
    assert go() == [] and state() == 40
    put([span(k, 8, "b") for k in range(35, 38)])  # these stay open for longer
    put(mark(17.95))  # five minutes late, ten open: questions up to the 29th
    closed = [(f"q{k}", "d", 0, 10, "AND", "g1", "a", False) for k in range(30)]
    assert go() == sorted(closed, key=str) and state() == 13
    put(mark(80))
    more = [(f"q{k}", "d", 0, 10, "AND", "g1", "a+b" if 35 <= k < 38 else "a", False) for k in range(30, 40)]
    assert go() == sorted(closed + more, key=str) and state() == 0


def test_state_is_asked_by_slot():
    """A hundred questions of a slot take as many messages as one."""

    class Counted:
        def __init__(self):
            self.calls, self.held = 0, []

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name == "appendList":
                    self.held += args[0]
                return iter(self.held) if name == "get" else False

            return call

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    def calls(questions):
        one = merging.MergeSpans(600_000, 0)
        one.handle, one.spans, one.times = Counted(), Counted(), Counted()
        rows = [dict(qid=f"q{k}", docid="d", start=0, end=9, src_ord=0, logic="AND", grp="g1", who="a", at_ms=k) for k in range(questions)]
        list(one.handleInputRows((0,), iter(rows), Times))
        return one.handle.calls + one.spans.calls + one.times.calls

    assert calls(100) == calls(1)
