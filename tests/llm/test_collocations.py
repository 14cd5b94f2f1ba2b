"""Collocations against counting every phrase, over small blocks, batches and ranges."""

import random
import re
import string
from collections import Counter

import pyarrow as pa
import pytest

from lodegauge.llm import collocations as co

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW))]


def phrases(rows, max_n):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, max_n, least, top):
    counts, n = phrases(rows, max_n)
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "of", "The", "é", "Éa", "x\x00", "x", "\x01", "\x00", "x\x01", "日本", "a-b", "w" * 300]
    some = lambda n: "".join(rng.choices(words, weights=[40, 20, 5, 9, 3, 3, 9, 3, 3, 3, 5, 3, 1])[0] + rng.choice([" ", " ", " ", " \t ", ", ", ".\n", "!?"]) for _ in range(n))
    out = [(rng.choice(["en", "fr", None, "und", "", "e\x00"]), some(rng.randrange(0, 90))) for _ in range(90)]
    out += [("en", "Of the people by the people")] * 40 + [("en", None), ("fr", ""), ("fr", " \t.,;"), (None, None), ("en", some(4000)), ("zz", "the the the the the")]
    return out


@pytest.mark.parametrize("block,batch,parts", [(1 << 22, 10000, 4), (50, 3, 13), (1, 1, 1)])
def test_as_counting_every_phrase(spark, rows, monkeypatch, block, batch, parts):
    monkeypatch.setattr(co, "BLOCK", block)
    if block == 1:
        rows = rows[:20] + rows[-50:-15]
    docs = spark.createDataFrame([(lang, text, "x", 1, 2) for lang, text in rows], "lang string, text string, phrase string, n long, key int").repartition(3)
    for k, v in (("spark.sql.execution.arrow.maxRecordsPerBatch", batch), ("spark.sql.shuffle.partitions", parts), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(k, v)
    try:
        got = sorted(tuple(r) for r in co.collocations(docs, 4, 5, 60).collect())
    finally:
        for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows, 4, 5, 60) and len(got) > 20 // block


def test_counts_of_all_prefixes_whatever_the_batches():
    rng = random.Random(8)
    keys = Counter(b"\0".join([b"en", *rng.choices([b"a", b"aa", b"b", b"bbbbbbbbbbbb", b"bbbbbbbbbbbc"], k=rng.randrange(0, 5))]) for _ in range(3000))
    want = Counter()
    for key, n in keys.items():
        for k in range(key.count(b"\0") + 1):
            want[b"\0".join(key.split(b"\0")[: k + 1])] += n
    ordered = sorted(keys, reverse=True)
    for borders in ([], [1], [300, 301, 500]):
        got = Counter()
        for a, b in zip([0, *borders], [*borders, len(ordered)]):
            stack = co.PrefixStack(4, 20)
            for i in range(a, b, 7):
                some = ordered[i : min(b, i + 7)]
                stack.take(pa.array(some, pa.binary()), pa.array([keys[s] for s in some]).to_numpy())
            stack.end()
            for key, n in stack.out:
                got[key] += n
        assert {k: n for k, n in got.items() if n >= 20} == {k: n for k, n in want.items() if n >= 20}


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_products_beyond_64_bits(spark, monkeypatch):
    huge = 6 * 10**15
    rows = [("en", [], 10**17)] + [("en", w.split(), f) for w, f in (("a", huge), ("b", huge + 1), ("c", 9 * 10**15), ("a b", huge - 1), ("b c", huge // 2), ("a b c", huge // 2))]
    monkeypatch.setattr(co, "phrase_counts", lambda *_: spark.createDataFrame(rows, "lang string, words array<string>, f long"))
    got = {r["phrase"]: r["score"] for r in co.collocations(None).collect()}
    assert got == {"a b": 2000000 * (huge - 1) // (2 * huge + 1), "a b c": min(2000000 * (huge // 2) // (huge + huge // 2), 2000000 * (huge // 2) // (huge - 1 + 9 * 10**15))}
