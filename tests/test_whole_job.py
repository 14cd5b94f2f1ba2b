"""Registered queries against brute force over the whole job, on the smallest tables."""

import math
import os
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest

from lodegauge.operators import alignment
from lodegauge.plans import contract

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_search_and_metrics_ask_every_twentieth_vector(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    m, label = np.stack(e.embedding).astype(np.float64), dict(zip(e.vec_id, e.label))
    run, measures = {}, {}
    for q in (i for i in e.vec_id if i % 20 == 0):
        score = np.round(m @ m[list(e.vec_id).index(q)], 8)
        # scores as in a run, then as 32-bit floats where measures order them
        best = sorted(((s, str(i)) for s, i in zip(score, e.vec_id) if i != q), reverse=True)[:20]
        run |= {(f"q{q}", c): (rank, round(s, 6)) for rank, (s, c) in enumerate(best, 1)}
        hits = [label[int(c)] == label[q] for _, c in sorted(((np.float32(s), c) for s, c in best), reverse=True)]
        relevant = sum(x == label[q] for x in e.label) - 1
        gain = sum(h / math.log2(r + 1) for r, h in enumerate(hits[:10], 1))
        measures[f"q{q}"] = {
            "map": sum(sum(hits[:r]) / r for r, h in enumerate(hits, 1) if h) / relevant, "ndcg_cut_10": gain / sum(1 / math.log2(r + 1) for r in range(1, min(relevant, 10) + 1)),
            "P_5": sum(hits[:5]) / 5, "P_10": sum(hits[:10]) / 10, "recall_20": sum(hits) / relevant, "recall_100": sum(hits) / relevant,
            "num_ret": 20, "num_rel": relevant, "num_rel_ret": sum(hits), "recip_rank": 1 / (hits.index(True) + 1) if any(hits) else 0,
        }
    assert len(measures) == len(e) / 20
    got = {(r["qid"], r["chunk_id"]): (r["rank"], r["score"]) for r in contract.QUERIES["topk_cosine"](spark, SF).collect()}
    assert got.keys() == run.keys() and all(got[k] == pytest.approx(run[k], abs=2e-6) for k in run)
    for name in ("eval_map", "eval_ndcg10", "eval_precision", "eval_recall", "eval_mrr", "eval_counts"):
        rows = {r["qid"]: {k: v for k, v in r.asDict().items() if k != "qid"} for r in contract.QUERIES[name](spark, SF).collect()}
        assert rows.keys() == measures.keys()
        for q, row in rows.items():
            assert row == pytest.approx({k: measures[q][k] for k in row}, abs=2e-6), (name, q)
    total = contract.QUERIES["eval_summary"](spark, SF).first()
    for k in ("map", "recip_rank", "P_10"):
        assert total[k] == pytest.approx(np.mean([x[k] for x in measures.values()]), abs=1e-4)
    assert total["num_rel"] == sum(x["num_rel"] for x in measures.values())


def tokens(text):
    """Starts (without the space before) and ends of runs of letters, digits, marks and _, and of other characters."""
    out, i = [], 0
    word = lambda c: c == "_" or unicodedata.category(c)[0] in "LNM"
    while i < len(text):
        i += text[i] == " "
        j = i + 1
        while word(text[i]) and j < len(text) and word(text[j]):
            j += 1
        out.append((i, j))
        i = j
    return out


def chunks_of(docid, text):
    """strategy, chunk_id, start, end of all four strategies."""
    for strategy, name, size, step in (("CHARWIN500_OV50", "CHARWIN500OV50", 500, 450), ("CHARBLOCK1000_NOV0", "CHARWIN1000OV0", 1000, 1000)):
        for i in range(max(math.ceil((len(text) - size) / step), 0) + 1):
            yield strategy, f"{name}-{docid}-{i:04d}", i * step, min(i * step + size, len(text))
    for i, m in enumerate(re.finditer(r"""[^.!?]*[.!?]+["')\]]*|[^.!?]+$""", text)):
        if s := m[0].strip(" "):
            start = m.start() + len(m[0]) - len(m[0].lstrip(" "))
            yield "SENT", f"SENT-{docid}-{i:04d}", start, start + len(s)
    t = tokens(text)
    for i in range(max(math.ceil((len(t) - 512) / 128), 0) + 1):
        part = t[i * 128 : i * 128 + 512]
        yield "TOKWIN512_S128", f"TOKWIN512S128-{docid}-{i:04d}", part[0][0], part[-1][1]


def test_alignment_takes_all_strategies(spark):
    text = {r["docid"]: r["text"] for r in contract.normal(spark, SF).collect() if r["text"]}
    chunks = {d: list(chunks_of(d, t)) for d, t in text.items()}
    pairs = [
        (c[0], s["qid"], c[1], both / (s["end"] - s["start"]), both / (c[3] - c[2]))
        for s in contract.derived_spans(spark, SF).collect() for c in chunks[s["docid"]]
        if s["start"] < s["end"] and (both := min(s["end"], c[3]) - max(s["start"], c[2])) > 0
    ]
    good = [p for p in pairs if p[3] >= contract.T and p[4] >= contract.C]
    names = {c[0] for rows in chunks.values() for c in rows}
    assert len(names) == 4
    q = contract.QUERIES
    stats = {r["strategy"]: (r["chunks"], r["docs"], r["mean_length"]) for r in q["chunk_stats"](spark, SF).collect()}
    lengths = {n: [c[3] - c[2] for rows in chunks.values() for c in rows if c[0] == n] for n in names}
    assert stats == {n: (len(x), len(text), pytest.approx(np.mean(x), abs=2e-6)) for n, x in lengths.items()}
    assert sorted((r["strategy"], r["qid"], r["chunk_id"]) for r in q["align_qrels"](spark, SF).collect()) == sorted({p[:3] for p in good})
    counts = {r["strategy"]: (r["alignments"], r["judgments"], r["queries"]) for r in q["align_counts"](spark, SF).collect()}
    assert counts == {n: (len(x), len({p[:3] for p in x}), len({p[1] for p in x})) for n in names if (x := [p for p in good if p[0] == n])}
    grid = {}
    for a in alignment.SPAN_GRID:
        for b in alignment.CHUNK_GRID:
            x = [p for p in pairs if p[3] >= a and p[4] >= b]
            m, n = (np.mean([p[i] for p in x]) if x else 0 for i in (3, 4))
            grid[a, b] = (len(x), m, n, 2 * m * n / (m + n) if x else 0)
    got = {(r["t_span"], r["t_chunk"]): (r["n"], r["avg_span"], r["avg_chunk"], r["f"]) for r in q["threshold_grid"](spark, SF).collect()}
    assert got.keys() == grid.keys() and all(got[k] == pytest.approx(grid[k], abs=2e-9) for k in grid)
    best = q["threshold_best"](spark, SF).first()
    assert (best["t_span"], best["t_chunk"]) == min(grid, key=lambda k: (-round(grid[k][3], 9), -grid[k][0], k))
