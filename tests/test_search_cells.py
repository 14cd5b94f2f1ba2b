"""Search through cells against all pairs: clusters, no clusters, odd vectors, one cell of nearly everything."""

import numpy as np
import pytest

from lodegauge.operators import retrieval


def brute(queries, chunks, k):
    dim = max(len(v) for _, v in queries + chunks if v)
    grow = lambda v: np.pad(np.array(v, np.float64), (0, dim - len(v)))
    held = [(i, grow(v)) for i, v in chunks if v]
    out = []
    for qid in sorted({q for q, v in queries if v}):
        scores = [(round(float(grow(v) @ m), 8), i) for q, v in queries if q == qid and v for i, m in held]
        out += [(qid, i, r, s) for r, (s, i) in enumerate(sorted(scores, reverse=True)[:k], 1)]
    return out


def got(spark, queries, chunks, k):
    q = spark.createDataFrame(queries, "qid string, embedding array<float>").repartition(2)
    c = spark.createDataFrame(chunks, "chunk_id string, embedding array<float>").repartition(3)
    rows = retrieval.retrieve(q, c, k).orderBy("qid", "rank").collect()
    return [(r["qid"], r["chunk_id"], r["rank"], r["score"]) for r in rows], retrieval.search(q, c, k)


def vectors(n, dim, seed, centres=0, spread=0.05):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim))
    if centres:
        c = np.random.default_rng(99).standard_normal((centres, dim))
        m = c[rng.integers(0, centres, n)] + spread * m
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32).tolist()


def same(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b] and [x[3] for x in a] == pytest.approx([x[3] for x in b], abs=2e-8)


def test_clustered_vectors_are_mostly_passed_over(spark):
    chunks = [(str(i), v) for i, v in enumerate(vectors(3000, 16, 1, 30))]
    queries = [(f"q{i}", v) for i, v in enumerate(vectors(40, 16, 2, 30))]
    rows, search = got(spark, queries, chunks, 5)
    same(rows, brute(queries, chunks, 5))
    assert search.share() < 0.25


@pytest.mark.parametrize("hold", [3, 16384])
def test_any_vectors(spark, monkeypatch, hold):
    monkeypatch.setattr(retrieval, "HOLD", hold)
    monkeypatch.setattr(retrieval, "BLOCK", 17)
    rng = np.random.default_rng(5)
    plain = [(rng.standard_normal(4) * rng.choice([0.01, 1, 30])).astype(np.float32).tolist() for _ in range(60)]
    chunks = [(str(i), v) for i, v in enumerate(plain)] + [("zero", [0.0] * 4), ("none", None), ("empty", []), ("short", [1.0]), ("long", [0.0] * 5 + [2.0])]
    chunks += [(f"same{i}", plain[0]) for i in range(80)] + [("7", plain[7])]
    queries = [("a", plain[0]), ("a", plain[1]), ("zero", [0.0] * 4), ("none", None), ("empty", []), ("far", [-x for x in plain[0]]), ("long", [0.0] * 5 + [1.0]), ("b", plain[9])]
    for k in (1, 7, 500):
        rows, search = got(spark, queries, chunks, k)
        same(rows, brute(queries, chunks, k))
    assert search.share() == 1.0


def test_nothing_to_search(spark):
    some = [("a", [1.0, 0.0])]
    assert got(spark, some, [], 3)[0] == [] and got(spark, [], some, 3)[0] == [] and got(spark, some, [("n", None)], 3)[0] == []
