"""Merged spans are cut where their document lies: the same rows as by a join, and no join of texts to spans."""

import random

from lodegauge.operators import spans


def test_spans_meet_their_texts_once(spark):
    rng = random.Random(5)
    docs = [(f"d{i}", "  ".join("".join(rng.choices("abc“é😀", k=rng.randrange(1, 9))) for _ in range(40))) for i in range(9)]
    docs += [("d1", "Another text of the same name, long enough to be cut here and there"), ("blank", " \n\t"), ("null", None), (None, "no name")]
    rows = []
    for i in range(600):
        s = rng.randrange(-3, 120)
        rows.append((rng.choice(["q1", "q2", None]), rng.choice([d for d, _ in docs] + ["lost"]), s, s + rng.choice([0, 1, 9, 12, 30]), "was", rng.choice(["AND", "OR"]), rng.choice([None, "g2"]), rng.choice(["a", "b", None]), i))
    rows.append(("q1", "d2", None, None, "was", "AND", None, "a", 600))
    found = spark.createDataFrame(rows, "qid string, docid string, start int, `end` int, text string, logic string, `group` string, sme_id string, src_ord long").repartition(5)
    texts = spark.createDataFrame(docs, "docid string, text string").repartition(3)
    once, joined = spans.merge_spans(found, texts), spans.merge_spans(found, texts, split=1 << 20)
    assert once.schema == joined.schema
    got, want = (sorted((tuple(r) for r in df.collect()), key=str) for df in (once, joined))
    assert got == want and {r[1] for r in got} == {*(f"d{i}" for i in range(9)), "blank", "null", "lost", None}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(once).count("Join") == 1  # of the names of missing documents; texts are not joined


def test_spans_are_derived_once(spark):
    from lodegauge.plans import contract

    df = contract.QUERIES["merge_contributors"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan  # the cutting pass; spans are read
