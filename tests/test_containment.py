"""Passages in documents against comparing every passage with every document."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodegauge.functions.text import normalize_offsets
from lodegauge.operators import containment as co
from lodegauge.operators.spans import locate_span, snippet_core, snippet_variants


def tables():
    rng = random.Random(9)
    words = ["ab", "abab", "é", "Éa", "日本語", "_x_", "the", "x", "a.b", "🙂"]
    some = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", ", "]) for _ in range(n))
    docs = [(str(i), some(rng.randrange(0, 60))) for i in range(60)]
    docs += [docs[3], (None, docs[4][1]), ("null", None), ("empty", ""), ("blank", " \n"), ("long", some(3000)), ("same", "ab" * 400), ("tail", "x the")]
    passages = [(i, docs[i][1][4:40]) for i in range(12)]
    passages += [(20, "ab ab"), (21, "AB"), (22, "é"), (23, "x"), (24, '"the x..."'), (25, "_the_"), (26, "_x_"), (27, None), (28, ""), (29, " ., "), (30, docs[65][1][100:4000]), (None, "the"), (20, "the ab"), (31, "nowhere at all"), (32, "*ab*"), (33, "abab" * 3)]
    return passages, docs


def brute(spark, passages, docs, snap):
    forms = {}
    for r in passages.select("passage_id", snippet_variants(snippet_core(F.col("text"))).alias("v")).collect():
        forms.setdefault((r["passage_id"], tuple(r["v"] or ())), 0)
        forms[r["passage_id"], tuple(r["v"] or ())] += 1
    out = []
    for docid, text in docs.select("docid", normalize_offsets(F.col("text"))).collect():
        for (passage, variants), times in forms.items():
            for number, v in enumerate(variants, 1):
                if v and text and v.lower() in text.lower():
                    places = [m.start() for m in re.finditer(f"(?={re.escape(v.lower())})", text.lower())]
                    for n, s in enumerate(places, 1):
                        e = s + len(v)
                        if snap:
                            s, e = text.rfind(" ", 0, s) + 1, min(x for x in (text.find(" ", e), len(text)) if x >= 0)
                        out += [(passage, docid, number, n, s, e, text[s:e])] * times
                    break
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def frames(spark):
    passages, docs = tables()
    extra = lambda rows, schema: spark.createDataFrame([(*r, 1, "y") for r in rows], schema + ", low int, v string").repartition(3).cache()
    return extra(passages, "passage_id long, text string"), extra(docs, "docid string, text string")


@pytest.mark.parametrize("snap,block,passage_bytes", [(True, 1 << 20, 1 << 22), (False, 40, 1 << 22), (True, 1, 60)])
def test_every_occurrence_is_found(spark, frames, monkeypatch, snap, block, passage_bytes):
    monkeypatch.setattr(co, "BLOCK", block)
    monkeypatch.setattr(co, "PASSAGE_BYTES", passage_bytes)
    got = sorted((tuple(r) for r in co.occurrences(*frames, snap=snap).collect()), key=str)
    assert got == brute(spark, *frames, snap) and len(got) > 500


def test_first_occurrences_are_those_of_locate_span(spark, frames):
    passages, docs = frames
    one = passages.where("passage_id = 25").select("passage_id", F.col("text").alias("snippet"))
    text = docs.select("docid", normalize_offsets(F.col("text")).alias("doc_text")).where("docid is not null and doc_text <> ''").distinct()
    want = {r["docid"]: (r["start"], r["end"]) for r in locate_span(text.join(F.broadcast(one))).where("start is not null").collect()}
    got = {r["docid"]: (r["start"], r["end"]) for r in co.occurrences(passages, docs).where("passage_id = 25 and occurrence = 1 and docid is not null").collect()}
    assert got == want and want


def test_a_variant_is_filed_under_its_rarest_piece():
    index = co.Index([(0, 1, b"the the rare one")])
    counts = {8: [0 if v == int.from_bytes(b"e rare o", "little") else 9 for v in index.grams[8].tolist()]}
    import numpy as np

    index.file({8: np.array(counts[8])})
    assert index.filed[8][0].values.tolist() == [int.from_bytes(b"e rare o", "little")] and index.filed[8][1] == [[(0, 6)]]


def test_empty_tables(frames):
    passages, docs = frames
    assert co.occurrences(passages.where("false"), docs).collect() == [] and co.occurrences(passages, docs.where("false")).collect() == []
