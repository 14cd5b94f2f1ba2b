"""Operators on hand-made rows and against independent models of their semantics."""

import json
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegauge.functions import text as tx
from lodegauge.operators import alignment, annotate, checks, chunking, documents, metadata, metrics, retrieval, spans
from lodegauge.sources import readers, schemas, sinks

SPACES = "".join(chr(c) for c in range(0x3001) if re.match(r"\s", chr(c)))


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text"))).first()[0]


def model_normal(t):
    for a, b in zip("’‘”“—–", "''\"\"--"):
        t = t.replace(a, b)
    return re.sub(r"\s+", " ", t).strip()


@pytest.mark.parametrize("t", ["", "   ", "a b c\u0085d\x0be\x1cf", "‘x’ “y” —–", "é́ 🙂  z", SPACES + "k" + SPACES, "İ"])
def test_normalize_offsets(spark, t):
    assert one(spark, t, tx.normalize_offsets) == model_normal(t)


@pytest.mark.parametrize("t", ["“Café”—‘x’–… •™﻿ \t y\r\nz\rw", "plain", ""])
def test_normalize_corpus(spark, t):
    want = unicodedata.normalize("NFC", t)
    for a, b in {"“": '"', "”": '"', "‘": "'", "’": "'", "—": " -- ", "–": "-", "…": "...", " ": " ", "•": "*", "™": "", "﻿": ""}.items():
        want = want.replace(a, b)
    want = re.sub(r"[ \t]+", " ", want).replace("\r\n", "\n").replace("\r", "\n")
    assert one(spark, t, tx.normalize_corpus) == want


def test_sections(spark):
    book = "x\nCHAPTER I. Down\nthe hole CHAPTER II. no\nCHAPTER II.\nPool\n body two \nTHE END\nTHE END"
    df = documents.extract_main_text(spark.createDataFrame([(book,)], "text string"))
    got = [tuple(r) for r in documents.split_sections(df).orderBy("docid").collect()]
    assert got == [("doc:ch01", "CHAPTER I. Down", "the hole CHAPTER II. no"), ("doc:ch02", "CHAPTER II.\nPool", "body two")]
    with pytest.raises(Exception, match="marker"):
        documents.extract_main_text(spark.createDataFrame([("none",)], "text string")).collect()


def test_unicode_scan(spark):
    df = spark.createDataFrame([("a", "x é\ty é é é"), ("b", None), ("c", "é\n")], "docid string, text string")
    r = documents.unicode_scan(df).first()
    assert (r["codepoint"], r["ch"], r["n"], r["more"], r["name"]) == (0xE9, "é", 5, 2, "LATIN SMALL LETTER E WITH ACUTE")
    assert r["examples"][0] == "x é\\ty é é é" and len(r["examples"]) == 3


def windows_model(t, size, over):
    out, i, step = [], 0, size - over
    for s in range(0, len(t), step) if step > 0 else []:
        e = min(s + size, len(t))
        if t[s:e].strip():
            out.append((i, s, e, t[s:e]))
            i += 1
        if e >= len(t):
            break
    return out


@pytest.mark.parametrize("size,over", [(500, 50), (10, 3), (7, 0), (1, 0), (5, 5), (4, 9)])
def test_char_windows(spark, size, over):
    rng = random.Random(size)
    texts = ["", "  ", "a", None] + ["".join(rng.choice("ab c.🙂") for _ in range(n)) for n in (size - 1, size, size + 1, 3 * (size - over or 1), 40)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "docid string, text string")
    got = sorted(tuple(r) for r in chunking.char_windows(df, size, over).collect())
    want = sorted((str(d), f"CHARWIN{size}OV{over}-{d}-{i:04d}", s, e, x) for d, t in enumerate(texts) for i, s, e, x in windows_model(model_normal(t or ""), size, over))
    assert got == want


def tokens_model(t, size, stride):
    toks = [(m.start(), m.end()) for m in re.finditer(r"[^\W]+|[^\w\s]", t)]
    out = []
    for i in range(0, len(toks), stride):
        w = toks[i : i + size]
        out.append((w[0][0], w[-1][1]))
        if i + size >= len(toks):
            break
    return out


@pytest.mark.parametrize("size,stride", [(512, 128), (6, 4), (3, 3), (4, 6)])
def test_token_windows(spark, size, stride):
    rng = random.Random(5)
    texts = ["", "one", None] + [" ".join(rng.choice(["a,", "bcd", "é!", "7-8", "..."]) for _ in range(n)) for n in (1, 2, 3, 4, 8, 9, 50, 700)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "docid string, text string")
    got = sorted((r["docid"], r["start"], r["end"], r["text"]) for r in chunking.token_windows(df, size, stride).collect())
    assert got == sorted((str(d), s, e, model_normal(t)[s:e]) for d, t in enumerate(texts) if t for s, e in tokens_model(model_normal(t), size, stride))


def test_sentences_are_slices(spark):
    t = 'One.  Two!? "Three." (x) . . end'
    df = spark.createDataFrame([("d", t), ("e", "")], "docid string, text string")
    got = chunking.sentences(df).orderBy("start").collect()
    n = model_normal(t)
    assert [r["text"] for r in got] == ["One.", "Two!?", '"Three."', "(x) .", ".", "end"] and all(n[r["start"] : r["end"]] == r["text"] for r in got)


def locate_model(doc, snippet):
    if not snippet:
        return None
    c = snippet.strip()
    for a, b in zip("’‘”“—–", "''\"\"--"):
        c = c.replace(a, b)
    c = re.sub(r"\s*(\.\.\.|…|\.\.)$", "", c).rstrip()
    c = re.sub(r"\s+", " ", c).strip().strip(",.\"' ")
    forms = [c]
    if len(c) > 2 and any(c[0] == c[-1] == m and not c.startswith(m + m) for m in "_*"):
        forms.append(c[1:-1])
    for f in forms:
        for v in dict.fromkeys([f, f.replace("_", " "), f.replace("_", "")]):
            at = doc.lower().find(v.lower()) if v else -1
            if at >= 0:
                s, e = at, at + len(v)
                while s > 0 and not doc[s - 1].isspace():
                    s -= 1
                while e < len(doc) and not doc[e].isspace():
                    e += 1
                return s, e, doc[s:e].strip()
    return None


def test_locate_span(spark):
    doc = "The quick brown fox, said \"Ann\", jumps over_the lazy dog. THE QUICK end"
    cases = ["quick brown", "“Ann”", "_lazy dog_", "*fox*", "over_the", "brown   fox...", "umps ov", "absent", ".,'\"", "", None, "the quick", "__x__", "dog..", "  end  "]
    df = spark.createDataFrame([(i, doc, s) for i, s in enumerate(cases)], "i int, doc_text string, snippet string")
    for r in spans.locate_span(df).collect():
        want = locate_model(doc, cases[r["i"]])
        assert (want is None and r["span_text"] is None) or want == (r["start"], r["end"], r["span_text"]), cases[r["i"]]


def merge_model(rows, text):
    rows, out, clash = sorted(rows, key=lambda r: (r[0], r[1], r[4])), [], []
    rows = [list(r) for r in rows if r[0] < r[1]]
    active = None
    for r in rows:
        if active is None:
            active = r
            continue
        ov = max(0, min(active[1], r[1]) - max(active[0], r[0]))
        near = ov > 0 and ov / (max(active[1], r[1]) - min(active[0], r[0])) >= 0.5
        if near and active[2] == r[2] and active[3] == r[3]:
            active = [min(active[0], r[0]), max(active[1], r[1]), *active[2:]]
        else:
            if near:
                clash.append((active[0], active[1], r[0], r[1]))
            out.append(active)
            active = r
    if active:
        out.append(active)
    return sorted((a[0], a[1], text[a[0] : a[1]].strip(), a[2], a[3]) for a in out if text[a[0] : a[1]].strip()), sorted(clash)


def test_merge_spans(spark):
    rng, text = random.Random(7), model_normal("lorem ipsum dolor sit amet " * 6)
    groups = {f"q{g}": [(s := rng.randrange(60), s + rng.randrange(-1, 30), rng.choice(["AND", "AND", "OR"]), rng.choice(["g1", "g1", "g2"]), k) for k in range(rng.randrange(1, 7))] for g in range(60)}
    rows = [(q, "d" if q != "q0" else "lost", s, e, "t", lo, None if g == "g1" else g, "s", o) for q, rs in groups.items() for s, e, lo, g, o in rs]
    df = spark.createDataFrame(rows, "qid string, docid string, start int, `end` int, text string, logic string, `group` string, sme_id string, src_ord int")
    docs = spark.createDataFrame([("d", text), ("d2", None)], "docid string, text string")
    got, bad = {}, {}
    for r in spans.merge_spans(df, docs).collect():
        got.setdefault(r["qid"], []).append((r["start"], r["end"], r["text"], r["logic"], r["group"]))
    for r in spans.merge_conflicts(df).collect():
        bad.setdefault(r["qid"], []).append((r["start_1"], r["end_1"], r["start_2"], r["end_2"]))
    for q, rs in groups.items():
        if q == "q0":  # passes through as it is
            assert len(got[q]) == len(rs)
            continue
        want, clash = merge_model(rs, text)
        assert sorted(got.get(q, [])) == want and sorted(bad.get(q, [])) == clash


def test_alignment_forms_agree(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["aa", "bbb", "c"]) for _ in range(2000))
    docs = spark.createDataFrame([("d", text)], "docid string, text string")
    rows = [(f"q{i}", "d", s := rng.randrange(len(text)), min(len(text), s + rng.choice([0, 1, 30, 400, 700]))) for i in range(80)]
    sp, ch = spark.createDataFrame(rows, "qid string, docid string, start int, `end` int"), chunking.char_windows(docs)
    pick = lambda d: sorted((r["qid"], r["chunk_id"]) for r in d.collect())
    want = sorted({(q, f"CHARWIN500OV50-d-{i:04d}") for q, _, s, e in rows if s < e for i, cs, ce, _ in windows_model(text, 500, 50) if (o := min(e, ce) - max(s, cs)) > 0 and o / (e - s) >= 0.6 and o / (ce - cs) >= 0.05})
    assert pick(alignment.align(sp, ch, 0.6, 0.05)) == want == pick(alignment.align(sp, ch, 0.6, 0.05, bucket=64))
    assert pick(alignment.align_char_windows(sp, spark.createDataFrame([("d", len(text))], "docid string, n int"), 500, 50, 0.6, 0.05)) == want
    best = alignment.threshold_best(alignment.threshold_grid(alignment.overlapping_pairs(sp, ch))).first()
    assert best["t_span"] in alignment.SPAN_GRID and best["n"] > 0
    none = alignment.threshold_grid(alignment.overlapping_pairs(sp.where("false"), ch)).collect()
    assert len(none) == 56 and all(r["n"] == 0 and r["f"] == 0 for r in none)


def test_retrieve_and_pool(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    q = spark.createDataFrame([("q", v[3].tolist()), ("n", None)], "qid string, embedding array<float>")
    c = spark.createDataFrame([(f"c{i:02d}", f"d{i}", x.tolist()) for i, x in enumerate(v)], "chunk_id string, docid string, embedding array<float>").repartition(3)
    got = [(r["chunk_id"], r["rank"]) for r in retrieval.retrieve(q, c, 5, docid="docid").orderBy("rank").collect()]
    assert [x[1] for x in got] == [1, 2, 3, 4, 5] and [x[0] for x in got[:2]] == ["c07", "c03"]
    assert retrieval.retrieve(q, c.where("chunk_id < 'c02'"), 20).count() == 2
    p = retrieval.mean_pool(spark.createDataFrame([([[1.0, 0.0], [9.0, 9.0], [0.0, 1.0]], [1, 0, 1])], "token_vectors array<array<float>>, mask array<int>")).first()["embedding"]
    assert np.allclose(p, [0.5**0.5] * 2)


def metric_model(run, rel):
    order = [c for c, _ in sorted(run.items(), key=lambda x: (np.float32(x[1]), x[0]), reverse=True)]
    hits = [int(rel.get(c, 0) > 0) for c in order]
    total = sum(v > 0 for v in rel.values())
    part = lambda x: x / total if total else 0.0
    gain = lambda g: sum(x / math.log2(i + 2) for i, x in enumerate(g[:10]))
    ideal = gain(sorted(rel.values(), reverse=True))
    return {
        "map": part(sum(sum(hits[: i + 1]) / (i + 1) for i, h in enumerate(hits) if h)), "ndcg_cut_10": gain([max(rel.get(c, 0), 0) for c in order]) / ideal if ideal else 0.0,
        "P_5": sum(hits[:5]) / 5, "P_10": sum(hits[:10]) / 10, "recall_20": part(sum(hits[:20])), "recall_100": part(sum(hits[:100])),
        "num_ret": len(order), "num_rel": total, "num_rel_ret": sum(hits), "recip_rank": 1 / (hits.index(1) + 1) if 1 in hits else 0.0,
    }


def test_metrics(spark):
    rng = random.Random(11)
    runs = {q: {f"c{i}": rng.choice([0.1, 0.2, 0.3, 0.3 + 1e-10]) for i in rng.sample(range(40), 25)} for q in ("a", "b", "c", "only_run")}
    rels = {q: {f"c{i}": rng.choice([0, 1, 2]) for i in rng.sample(range(40), 9)} for q in ("a", "b", "only_rel")} | {"c": {"c1": 0}}
    run = spark.createDataFrame([("s", q, c, x) for q, r in runs.items() for c, x in r.items()], "strategy string, qid string, chunk_id string, score double")
    qrels = spark.createDataFrame([("s", q, c, x) for q, r in rels.items() for c, x in r.items()], "strategy string, qid string, chunk_id string, rel int")
    got = {r["qid"]: r.asDict() for r in metrics.per_query(run, qrels).collect()}
    assert set(got) == {"a", "b", "c"}
    for q in got:
        for m, x in metric_model(runs[q], rels[q]).items():
            assert abs(got[q][m] - x) < 1e-9, (q, m)
    s = metrics.summary(run, qrels).first()
    assert s["num_ret"] == 75 and abs(s["map"] - round(sum(g["map"] for g in got.values()) / 3, 4)) < 1e-9


def test_malformed_lines(spark):
    lines = ["q 0 c 1", "q\t0\tc\t2", "q 0 c", "q 0 c x", "q 0 c 1 2", " q 0 d 1 "]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "strategy string, line_no long, value string")
    assert sorted((r["chunk_id"], r["rel"]) for r in metrics.parse_qrels(df).collect()) == [("c", 2), ("d", 1)]
    lines = ["q Q0 c 1 0.5 r", "q Q0 c 1 0.25 r", "q Q0 c 1 r", "q Q0 c 1 z r", "q Q0 c 1 1 r x"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "strategy string, line_no long, value string")
    assert [(r["chunk_id"], r["score"]) for r in metrics.parse_run(df).collect()] == [("c", 0.25)]


def test_checks(spark):
    docs = spark.createDataFrame([("d", "Hello  there"), ("e", ""), ("f", None)], "docid string, text string")
    q = spark.createDataFrame([("q1", "d"), ("q2", "e"), ("q3", "zz"), ("q4", "d"), ("q5", "d"), ("q6", None)], "qid string, docid string")
    rows = [("q1", 0, 5, "Hello"), ("q1", 5, 11, "there"), ("q1", 0, 99, "x"), ("q1", None, 2, "x"), ("q2", 0, 0, ""), ("q3", 0, 1, "x"), ("q5", 0, 5, "hello"), ("zz", 0, 1, "a")]
    a = spark.createDataFrame(rows, "qid string, start int, `end` int, text string")
    got = sorted((r["qid"], r["code"]) for r in checks.check_annotations(q, a, docs, "s").collect())
    assert got == [("q1", "s:INVALID_OFFSETS"), ("q1", "s:INVALID_OFFSETS"), ("q2", "DOC_EMPTY_OR_NO_TEXT_FIELD"), ("q3", "DOC_NOT_FOUND"), ("q4", "s:NO_SPAN_FOR_QUESTION"), ("q5", "s:TEXT_MISMATCH")]
    c = spark.createDataFrame([("d", "a", 0, 5, "Hello"), ("d", "b", 0, 5, "Hell"), ("d", "c", 0, None, "x"), ("x", "e", 0, 1, "x"), ("d", "f", 4, 2, "")], "original_doc_id string, chunk_id string, start int, `end` int, text string")
    assert sorted((r["chunk_id"], r["code"]) for r in checks.check_chunks(c, docs).collect()) == [("b", "TEXT_MISMATCH"), ("c", "MISSING_FIELDS:end"), ("e", "DOC_NOT_FOUND"), ("f", "INVALID_OFFSETS")]
    assert sinks.exit_code(checks.check_chunks(c, docs)) == 1


def test_distribution_report(spark):
    q = spark.createDataFrame([("q1", "d1", "x" * 120, 0), ("q2", "d1", "short", 1), ("q3", "d2", "none", 2)], "qid string, docid string, question string, src_ord int")
    a = spark.createDataFrame([("q1", "AND", 0), ("q1", "OR", 1), ("q2", "OR", 2), ("zz", "AND", 3)], "qid string, logic string, src_ord int")
    text = checks.distribution_report(q, a)
    assert "- **Question:** " + "x" * 100 + "..." in text and "**Total spans in d1:** 3" in text and "- **Questions without spans:** 1" in text
    assert "- **COMPLETE_SPAN**: 0\n- **AND**: 2\n- **OR**: 2" in text and "- **Logic type:** N/A" in text


def test_replies(spark):
    bad = ["not json", '{"answers": "x"}', '{"answers": []}', '{"answers": [" "], "logic": "AND"}', None]
    good = ['```json\n{"answers": ["a", " "], "logic": "NO"}\n```', '{"answers": ["a", "b"]}', '{"answers": [" a "], "logic": "AND"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(good + bad)], "i int, reply string")
    assert sorted((r["i"], r["answers"], r["logic"]) for r in annotate.parse_answers(df).collect()) == [(0, ["a"], "COMPLETE_SPAN"), (1, ["a", "b"], "OR"), (2, ["a"], "AND")]
    qs = annotate.parse_questions(spark.createDataFrame([("d", '{"questions": ["x?", " ", null]}'), ("e", "[]")], "docid string, reply string")).collect()
    assert [(r["question"], r["group"], len(r["qid"])) for r in qs] == [("x?", "g1", 10)]
    failing = annotate.ask(spark.createDataFrame([("p",)], "prompt string"), lambda: (lambda prompts: 1 / 0))
    assert failing.first()["reply"] is None


def test_files_round_trip(spark, tmp_path):
    docs = [("bk:ch01", "A\nB", "text ‘é’"), ("bk:ch02", "C", "")]
    df = spark.createDataFrame(docs, schemas.DOCUMENT)
    assert sinks.export_documents(df, str(tmp_path / "docs")) == 2
    assert [tuple(r) for r in readers.json_documents(spark, str(tmp_path / "docs")).orderBy("docid").collect()] == docs
    ch = chunking.char_windows(df, 4, 0).withColumn("strategy", F.lit("w"))
    sinks.chunk_manifests(ch, str(tmp_path / "chunks"))
    assert readers.json_lines(spark, str(tmp_path / "chunks" / "strategy=w")).count() == ch.count()
    qrels = spark.createDataFrame([("w", "q2", "c", 1), ("w", "q1", "d", 1)], "strategy string, qid string, chunk_id string, rel int")
    sinks.qrels(qrels, str(tmp_path / "qrels"))
    lines = spark.read.text(str(tmp_path / "qrels" / "strategy=w")).select(F.lit("w").alias("strategy"), "value").orderBy("value")
    assert [r["value"] for r in lines.collect()] == ["q1\t0\td\t1", "q2\t0\tc\t1"]
    names = sinks.export_strategy_files(lines, str(tmp_path / "txt"), "qrels")
    assert names == [str(tmp_path / "txt" / "qrels_w.txt")]
    assert sorted((r["strategy"], r["qid"], r["rel"]) for r in readers.qrels(spark, str(tmp_path / "txt")).collect()) == [("w", "q1", 1), ("w", "q2", 1)]
    run = spark.createDataFrame([("w", "q", "c", 1, 0.5, "r")], "strategy string, qid string, chunk_id string, rank int, score double, run_name string")
    sinks.runs(run, str(tmp_path / "runs"))
    assert spark.read.text(str(tmp_path / "runs" / "strategy=w")).first()[0] == "q\tQ0\tc\t1\t0.50000000\tr"
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "x", "start": 1}\nbroken\n')
    got = readers.json_lines_checked(spark, str(tmp_path / "a.jsonl")).orderBy("line_no").collect()
    assert [(r["line_no"], r["chunk_id"], r["_corrupt_record"]) for r in got] == [(1, "x", None), (2, None, "broken")]
    np.savez_compressed(tmp_path / "e.npz", ids=np.array(["a"]), docids=np.array(["d"]), embeddings=np.ones((1, 3), np.float32))
    assert readers.embeddings_npz(spark, str(tmp_path / "e.npz")).first()["embedding"] == [1.0, 1.0, 1.0]
    assert sinks.export_json_array(df, str(tmp_path / "arr.json")) == 2
    assert readers.json_array(spark, str(tmp_path / "arr.json"), schemas.DOCUMENT).count() == 2


def test_metadata(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (None, "b", 2.0)], "n int, s string, x double")
    m = metadata.table_metadata(df, "t.csv")
    assert (m["number_of_rows"], m["number_of_columns"], [c["type"] for c in m["columns"]]) == (2, 3, ["float64", "object", "float64"])
    j = metadata.json_metadata(df, "t.json")
    assert [c["type"] for c in j["columns"]] == ["int", "str", "NoneType"]
    path = sinks.metadata(m, str(tmp_path / "t.csv"))
    assert json.load(open(path))["file_name"] == "t.csv"


def test_stream_of_documents(spark, tmp_path):
    from lodegauge.streaming import pipelines

    docs = spark.createDataFrame([("d", "lorem ipsum " * 100)], "docid string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    sp = spark.createDataFrame([("q", "d", 10, 300)], "qid string, docid string, start int, `end` int")
    stream = pipelines.aligned_stream(pipelines.document_stream(spark, str(tmp_path / "in"), "docid string, text string"), sp, t_chunk=0.1)
    pipelines.run_once(stream, "aligned", str(tmp_path / "cp"), str(tmp_path / "out"))
    want = alignment.aligned_pairs(sp, chunking.char_windows(docs), t_chunk=0.1)
    assert sorted(r["chunk_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(r["chunk_id"] for r in want.collect())
