"""Ranked search against scoring every document, in small blocks and large ones, and how much the treaps leave out."""

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from lodegauge.llm import lexical_search as ls

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, k):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for doc, c, size in held:
            norm = 75 + 25 * size * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * norm)) for t, times in asked.items() if t in c)
            if score > 0:
                found.append((-score, -math.inf if doc is None else doc))
        out += [(item, r, None if d == -math.inf else d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdé", k=rng.randrange(1, 5))) for _ in range(60)]
    some = lambda n: " ".join(rng.choices(words, weights=range(60, 0, -1), k=n))
    docs = [(i, some(rng.randrange(1, 60))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(60)] + [docs[3], docs[3], (None, docs[7][1]), (None, None), (901, None), (902, ""), (903, "... \t"), (904, some(9000)), (905, "x" * 100_000 + " " + docs[7][1])]
    items = [(i, some(12).upper()) for i in range(8)] + [(20, docs[7][1]), (21, None), (22, "?!"), (23, "nowhere"), (24, "x" * 100_000), (25, "É é à " + docs[7][1]), (None, some(3))]
    return docs, items


@pytest.mark.parametrize("postings,chunk,item_bytes", [(1 << 20, 1 << 13, 1 << 22), (100, 3, 90), (1, 1, 1 << 22)])
def test_the_best_are_those_of_every_document(spark, tables, monkeypatch, postings, chunk, item_bytes):
    docs, items = tables
    monkeypatch.setattr(ls, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(ls, "CHUNK", chunk)
    monkeypatch.setattr(ls, "ITEM_BYTES", item_bytes)
    if postings == 1:
        docs, items = docs[:24], items[:5]
    a = spark.createDataFrame([(*d, 1, "x", 0) for d in docs], "doc_id long, text string, rank int, item string, score long").repartition(3)
    b = spark.createDataFrame([(*i, 5) for i in [*items, items[0]]], "item_id long, text string, doc_id long")
    got = sorted((tuple(r) for r in ls.search(a, b, 4).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute(docs, items, 4)


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame(tables[0], "doc_id long, text string")
    items = spark.createDataFrame(tables[1], "item_id long, text string")
    assert ls.search(docs.where("false"), items).collect() == [] and ls.search(docs, items.where("false")).collect() == []


def test_treaps_are_heaps_in_search_order():
    rng = np.random.default_rng(1)
    impact, first = rng.integers(1, 50, 3000), np.array([0, 0, 1000, 1001, 3000])
    left, right, roots = ls.treaps(first, impact)
    assert roots[0] == -1

    def walk(node, depth=0):
        if node < 0:
            return [], 0
        a, b = walk(left[node]), walk(right[node])
        assert all(impact[c] <= impact[node] for c in (left[node], right[node]) if c >= 0)
        return a[0] + [node] + b[0], 1 + max(a[1], b[1])

    for t in range(1, 4):
        nodes, depth = walk(roots[t])
        assert nodes == list(range(first[t], first[t + 1])) and depth < 40


def test_intervals_that_cannot_enter_are_left_out():
    rng = np.random.default_rng(2)
    doc, term = np.repeat(np.arange(20000), 20), rng.zipf(1.3, 400000) % 3000
    key = np.unique(doc * 3000 + term)
    doc, term, impact = key // 3000, key % 3000, rng.integers(300_000, 500_000, len(key))
    asked = np.sort(rng.choice(3000, (5, 12), replace=False), 1)
    weights = np.array([[math.floor(1000 * math.log(40002 / (2 * (term == t).sum() + 1))) for t in row] for row in asked])
    best = ls.Best(5, 20)
    seen = ls.search_block(doc, term, impact, np.arange(20000), asked, weights, best)
    for q in range(5):
        score = np.zeros(20000, np.int64)
        for t, w in zip(asked[q], weights[q]):
            score[doc[term == t]] += w * impact[term == t]
        want = np.lexsort((np.arange(20000), -score))[:20]
        assert best.doc[best.item == q].tolist() == want.tolist() and best.score[best.item == q].tolist() == score[want].tolist()
    assert seen < 0.5 * 5 * 20000


def test_other_slices_with_an_asked_hash_do_not_count(monkeypatch):
    monkeypatch.setattr(ls.bw.Hashes, "of", lambda self, start, end: np.full(len(start), 5, np.uint64))
    asked = ls.Asked(["abcdefghij"])
    buf = np.frombuffer(b"abcdefghij abcdefghik abcdefghij abc", np.uint8)
    at = np.array([0, 11, 22, 33])
    assert asked.found(ls.bw.Hashes(buf), at, np.array([10, 21, 32, 36])).tolist() == [0, -1, 0, -1]
