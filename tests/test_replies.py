"""A generator is asked nothing twice: second runs, repeated prompts, lost tasks; failures are kept."""

import collections
import os
import uuid

import pytest
from pyspark.sql import functions as F

from lodegauge.operators import replies


def counting(folder, dies_at=None, fails=()):
    def make():
        def generate(prompts):
            for p in prompts:
                open(os.path.join(folder, uuid.uuid4().hex), "w").write(p)
                if p in fails:
                    raise ValueError(f"cannot say {p}")
            if dies_at is not None and len(os.listdir(folder)) >= dies_at:
                os._exit(1)  # as a lost executor
            return [p.upper() for p in prompts]

        return generate

    return make


def asked(folder):
    return collections.Counter(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


@pytest.fixture()
def folders(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls"), str(tmp_path / "store")


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, f"p{i % 30}", "x") for i in range(100)] + [(100, None, "y"), (101, "", "y")]
    return spark.createDataFrame(data, "id long, prompt string, digest string").repartition(3)


def test_prompts_are_asked_once_over_runs(rows, folders):
    calls, store = folders
    for _ in range(2):
        got = {r["id"]: (r["reply"], r["error"]) for r in replies.ask(rows, counting(calls), store, batch=4, flush=8).collect()}
        assert got == {i: (f"P{i % 30}", None) for i in range(100)} | {100: (None, None), 101: ("", None)}
    assert asked(calls) == collections.Counter({f"p{i}": 1 for i in range(30)} | {"": 1})
    more = rows.withColumn("prompt", F.when(F.col("id") == 5, "new").otherwise(F.col("prompt")))
    assert {r["id"]: r["reply"] for r in replies.ask(more, counting(calls), store).collect()}[5] == "NEW"
    assert asked(calls)["new"] == 1 and sum(asked(calls).values()) == 32
    replies.ask(rows, counting(calls), store, name="other").count()
    assert asked(calls)["p1"] == 2


def test_a_lost_task_goes_on_from_what_it_wrote(rows, folders):
    calls, store = folders
    with pytest.raises(Exception):  # noqa: B017  the worker process ends
        replies.ask(rows, counting(calls, dies_at=12), store, batch=1, flush=1).collect()
    got = {r["id"]: r["reply"] for r in replies.ask(rows, counting(calls), store, batch=1, flush=1).collect()}
    assert got[7] == "P7" and got[101] == "" and len(got) == 102
    times = asked(calls)
    # prompts whose reply was not written yet, one a task
    assert len(times) == 31 and sum(n - 1 for n in times.values()) <= 4


def test_failures_are_kept_and_asked_again_on_demand(rows, folders):
    calls, store = folders
    got = {r["id"]: (r["reply"], r["error"]) for r in replies.ask(rows, counting(calls, fails={"p3", "p4"}), store, batch=8, attempts=2).collect()}
    assert got[3] == (None, "ValueError: cannot say p3") == got[33] and got[5] == ("P5", None)
    before = asked(calls)
    assert before["p3"] in (2, 3) and before["p4"] in (2, 3)
    replies.ask(rows, counting(calls), store).count()
    assert asked(calls) == before
    again = {r["id"]: (r["reply"], r["error"]) for r in replies.ask(rows, counting(calls), store, again=True).collect()}
    assert again[3] == ("P3", None) and again[34] == ("P4", None) and asked(calls)["p5"] == before["p5"]


def test_empty_table(rows, folders):
    assert replies.ask(rows.where("false"), counting(folders[0]), folders[1]).collect() == []
