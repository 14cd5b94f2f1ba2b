"""What a store of replies needs besides its replies grows with the texts, not with the prompts that hold them, and is given up at once."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from lodegauge.functions import text as tx
from lodegauge.operators import annotate, replies, spans
from lodegauge.sources import scratch


def _docs(spark, n=60, size=4000):
    draw = random.Random(1)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyzé", k=6)) for _ in range(5000)]
    data = [(str(i), " ".join(draw.choice(words) + draw.choice(["", "", "", "", "."]) for _ in range(size // 7))) for i in range(n)]
    return scratch.written(spark.createDataFrame(data, "docid string, text string").repartition(2), "docs")


def _shuffle_files(spark) -> dict[str, int]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for top in folders for d, _, names in os.walk(top.getPath()) for f in names if f.startswith("shuffle_")}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [True, False])
def test_shuffle_files_are_given_up(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(scratch, "LOOKUP_BYTES", (16 << 20) if few else 0)
    docs, store = _docs(spark), str(tmp_path / "store")
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before = _shuffle_files(spark)
    with scratch.released(spark):
        q = scratch.written(annotate.generate_questions(docs, store=store), "questions")
        got = scratch.written(annotate.annotate(q, docs, "a", store=store), "annotations")
    assert got.count() > 300
    left = sum(n for f, n in _shuffle_files(spark).items() if f not in before)
    assert left < texts  # 1.2 and 4.6 times the texts when prompts were exchanged and files kept
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_prompts_are_exchanged_once_or_not_at_all(spark, tmp_path, monkeypatch):
    plans, fill = [], replies._fill

    def seen(deal, unseen, *rest):
        monkeypatch.setattr(scratch, "LOOKUP_BYTES", 0)
        plans.append(_plan(deal(unseen, 9999, 7)))
        return fill(deal, unseen, *rest)

    monkeypatch.setattr(replies, "_fill", seen)
    docs, store = _docs(spark, 9), str(tmp_path / "store")
    with scratch.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        q = scratch.written(annotate.generate_questions(docs, store=store), "questions")
        annotate.annotate(q, docs, "a", store=store).count()
    assert plans[0].count("Exchange hashpartitioning(digest") == 2 == plans[0].count("Exchange")
    above = plans[1].split("Join")[0]
    assert "Copy from the document" in above and "Exchange" not in above


def test_answers_by_parts_are_those_without_a_store(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def make():
        plain = annotate.offline_generator()

        def generate(prompts):
            with open(asked / str(os.getpid()), "a") as f:
                f.writelines(f"{p!r}\n" for p in prompts)
            return plain(prompts)

        return generate

    told = lambda: [line for f in asked.iterdir() for line in open(f)]
    texts = [("a", "One is. Two is! Three?"), ("a", "One is. Other."), ("b", None), ("c", "Same. Text."), ("c", "Same. Text."), (None, "x."), ("e", "")]
    docs = spark.createDataFrame(texts, "docid string, text string")
    rows = [("q1", "Is One is. so?", "a", "g2"), ("q2", "Is One is. so?", "a", None), ("q3", "Two is!", "a", "g1"), ("q4", "Same.", "c", "g1"), ("q5", "x", "b", "g1"), ("q6", "x", "zz", "g1"), ("q7", None, "a", "g1"), ("q8", "x", None, "g1"), ("q9", "x", "e", "g1")]
    q = spark.createDataFrame(rows, "qid string, question string, docid string, `group` string").repartition(3)
    want = sorted(map(str, annotate.annotate(q.where("question is not null"), docs, "s").collect()))
    got = [sorted(map(str, annotate.annotate(q, docs, "s", make, store=str(tmp_path / "store")).collect())) for _ in range(2)]
    assert got == [want, want] and len(want) > 5
    lines = told()
    assert len(lines) == len(set(lines)) == 7  # a: two texts, two questions; c: one; b, e
    more = q.unionByName(spark.createDataFrame([("q10", "Three?", "a", "g1")], q.schema))
    assert annotate.annotate(more, docs, "s", make, store=str(tmp_path / "store")).count() > len(want)
    assert len(told()) == 9


def test_a_reply_is_parsed_once(spark):
    told = spark.createDataFrame([("d", '{"answers": ["a"]}')], "docid string, reply string")
    parsed = annotate.parse_answers(told).select("docid", "logic", F.explode("answers").alias("snippet"))
    assert _plan(parsed).count("from_json(") == 1
    assert [tuple(r) for r in parsed.collect()] == [("d", "COMPLETE_SPAN", "a")]


def test_trimming_by_characters_is_the_expression(spark):
    c, space = F.col("c"), f"^[{tx.SPACE}]+|[{tx.SPACE}]+$"
    draw = random.Random(2)
    odd = [*tx.SPACES, *"a.,\"'…_*é😀’”—", "..", "...", "```", "json", "{", "}"]
    texts = [None, "", *map("".join, itertools.product(["", " ", "\n", " ", "..", "…", "```", "{", "}"], repeat=4)), *("".join(draw.choices(odd, k=7)) for _ in range(5000))]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    strip = lambda x: F.regexp_replace(x, space, "")
    dots = F.regexp_replace(F.translate(strip(c), tx.CURLY, tx.PLAIN), rf"[{tx.SPACE}]*(?:\.\.\.|…|\.\.)$", "")
    core = F.regexp_replace(F.trim(F.regexp_replace(dots, f"[{tx.SPACE}]+", " ")), """^[,."' ]+|[,."' ]+$""", "")
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    for new, old in ((tx.strip(c), strip(c)), (spans.snippet_core(c), core), (annotate.unfenced(c), bare)):
        assert df.where(~new.eqNullSafe(old)).count() == 0
