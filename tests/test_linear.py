"""Operators on long inputs and broken files: time in proportion, exact slices, errors that are kept."""

import json
import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from lodegauge.operators import annotate, checks, chunking, documents, retrieval, spans
from lodegauge.sources import readers


def test_many_sentences_of_one_document_take_linear_time(spark):
    chunking.sentences(spark.createDataFrame([("d", "Ab c!")], "docid string, text string")).count()  # workers are there
    df = spark.createDataFrame([("d", "Ab c! " * 100_000)], "docid string, text string")
    began = time.perf_counter()
    got = chunking.sentences(df).agg(F.count("*").alias("n"), F.max("end").alias("e")).first()
    assert tuple(got) == (100_000, 599_999) and time.perf_counter() - began < 10


def test_many_spans_of_one_question_take_linear_time(spark):
    rows = [("q", "d", 2 * i, 2 * i + 10 + i % 3, "x", "AND" if i % 7 else "OR", "g1", f"s{i % 2}", i) for i in range(30_000)]
    df = spark.createDataFrame(rows, "qid string, docid string, start int, `end` int, text string, logic string, `group` string, sme_id string, src_ord long")
    began = time.perf_counter()
    merged, clashes, active = 0, 0, None
    for _, _, s, e, _, logic, *_ in rows:
        shared = min(active[1], e) - max(active[0], s) if active else 0
        close = shared > 0 and 2 * shared >= max(active[1], e) - min(active[0], s)
        if close and active[2] == logic:
            active = (min(active[0], s), max(active[1], e), logic)
            continue
        clashes, merged, active = clashes + bool(close), merged + 1, (s, e, logic)
    assert spans.merge_conflicts(df).count() == clashes > 0
    assert spans._fold(df).where("not clash").count() == merged
    assert time.perf_counter() - began < 12


@pytest.mark.parametrize("size,stride", [(4, 2), (5, 5), (512, 128)])
def test_tokenizer_windows(spark, size, stride):
    texts = {"a": "The cat  sat — on “naïve” mats. 日本語 🙂 x" * 3, "b": "", "c": "   ", "d": "one", "e": None}
    offsets = chunking.public_tokenizer()()
    df = spark.createDataFrame(list(texts.items()), "docid string, text string")
    normal = {r["docid"]: r["text"] for r in chunking._normal(df).collect()}
    want = []
    for d, t in normal.items():
        at, number = offsets(t) if t else [], 0
        for i in range(0, len(at), stride):
            part = at[i : i + size]
            if t[part[0][0] : part[-1][1]].strip():
                want.append((d, f"TOKWIN{size}S{stride}-{d}-{number:04d}", part[0][0], part[-1][1], t[part[0][0] : part[-1][1]]))
                number += 1
            if i + size >= len(at):
                break
    assert sorted(map(tuple, chunking.tokenizer_windows(df, chunking.public_tokenizer(), size, stride).collect())) == sorted(want)


def test_packed_sentences_hold_whole_sentences(spark):
    rng = random.Random(1)
    text = " ".join(" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 30))) + "." for _ in range(60)) + " " + "x " * 100
    df = spark.createDataFrame([("d", text), ("e", "  "), ("f", None)], "docid string, text string")
    got = chunking.packed_sentences(df, 20).orderBy("chunk_id").collect()
    tokens = lambda t: len(regex.findall(chunking.TOKEN, t))
    t = text.strip()
    assert all(r["text"] == t[r["start"] : r["end"]] and 0 < tokens(r["text"]) <= 20 for r in got)
    assert "".join(r["text"].replace(" ", "") for r in got) == t.replace(" ", "")
    ends = {r["end"] for r in got}
    packed = [(r["start"], r["end"]) for r in got]
    for s, e in ((x["start"], x["end"]) for x in chunking.sentences(df.where("docid = 'd'")).collect()):
        if tokens(t[s:e]) <= 20:
            assert any(a <= s and e <= b for a, b in packed)  # no short sentence is cut
        else:
            assert e in ends or any(a < e <= b for a, b in packed)


def test_unicode_examples_are_the_first(spark):
    rows = [(f"{i:03d}", f"plain {i} é here\tand\né {'ü' * (i % 3)}") for i in range(40)] + [("x", None), ("y", "Å ascii")]
    df = spark.createDataFrame(rows, "docid string, text string").repartition(7)
    got = {r["ch"]: r for r in documents.unicode_scan(df, examples=2).collect()}
    assert got["é"]["n"] == 80 and got["é"]["more"] == 78 and got["ü"]["n"] == sum(i % 3 for i in range(40))
    assert got["é"]["examples"] == ["plain 0 é here\\tand\\né "] * 2 and got["é"]["name"] == "LATIN SMALL LETTER E WITH ACUTE"


def test_blocks_of_vectors_meet_in_groups(spark, monkeypatch):
    """Many blocks and groups, null and empty vectors: the same as all pairs."""
    for name, n in (("BLOCK", 7), ("HOLD", 2)):
        monkeypatch.setattr(retrieval, name, n)
    rng = random.Random(2)
    rows = [(f"c{i:03d}", [rng.random(), rng.random(), rng.random()]) for i in range(100)] + [("n", None), ("e", [])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(5)
    q = df.where("chunk_id < 'c010' or chunk_id in ('n', 'e')").withColumnRenamed("chunk_id", "qid")
    vectors = {r["chunk_id"]: r["embedding"] for r in df.collect() if r["embedding"]}
    want = {}
    for a in [f"c{i:03d}" for i in range(10)]:
        score = sorted(((round(sum(x * y for x, y in zip(vectors[a], v)), 8), c) for c, v in vectors.items()), reverse=True)[:4]
        want |= {(a, rank): c for rank, (_, c) in enumerate(score, 1)}
    got = {(r["qid"], r["rank"]): r["chunk_id"] for r in retrieval.retrieve(q, df, 4).where("qid like 'c%'").collect()}
    assert got == want
    assert retrieval.retrieve(q.where("false"), df, 4).count() == 0


def test_unreadable_documents_and_further_runs_are_told(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"docid": "a", "title": "t", "text": "some text"}))
    (folder / "b.json").write_text("{broken")
    q = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "qid string, docid string")
    a = spark.createDataFrame([(str(i), 0, 4, "some") for i in (1, 2, 3)], "qid string, start int, `end` int, text string")
    got = {r["qid"]: r["code"] for r in checks.check_annotations(q, a, readers.json_documents(spark, str(folder), checked=True), "s").collect()}
    assert got.keys() == {"2", "3"} and got["2"].startswith("DOC_LOAD_OR_NORMALIZE_ERROR: Expecting") and got["3"] == "DOC_NOT_FOUND"
    runs = tmp_path / "runs"
    runs.mkdir()
    for name, score in (("run_b_S_1.txt", 2), ("run_a_S_1.txt", 1), ("run_a_T.txt", 3)):
        (runs / name).write_text(f"q1 Q0 c1 1 {score} x\n")
    assert sorted(map(tuple, readers.runs(spark, str(runs)).collect())) == [("S_1", "q1", "c1", 1.0), ("T", "q1", "c1", 3.0)]
    assert [tuple(r) for r in readers.ambiguous_runs(spark, str(runs)).collect()] == [("S_1", "run_b_S_1.txt")]


def test_lines_of_split_files_keep_their_order(spark, tmp_path):
    """The last line of a (query, chunk) counts, in whatever splits a file is read."""
    lines = [f"q{i % 7}\t0\tc{i % 5}\t{i % 4}" for i in range(5000)]
    (tmp_path / "qrels_S.txt").write_text("\n".join(lines) + "\n")
    want = {}
    for line in lines:
        q, _, c, rel = line.split("\t")
        want[q, c] = int(rel)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {(r["qid"], r["chunk_id"]): r["rel"] for r in readers.qrels(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_failures_of_a_generator_are_counted(spark):
    def broken():
        def reply(prompts):
            raise RuntimeError("no answer")

        return reply

    got = annotate.ask(spark.createDataFrame([("a", "p"), ("b", "p")], "docid string, prompt string"), broken)
    assert [tuple(r) for r in annotate.failures(got).collect()] == [("RuntimeError: no answer", 2)] and annotate.parse_questions(got).count() == 0
