"""Streaming deduplication against grouping all texts: several batches, restarts, weak digests, odd rows."""

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from lodegauge.llm import exact_dedup as ed

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, digest string, file string, `row` int, n long, bit int, bits string, word int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    texts = [None, "", "", " ", "a", "A", "á", "Á", "ẞ", "ß", "İ", "x" * 200_000, "X" * 200_000, "İA", "İa"]
    texts += [rng.choice(["same here", "Same HERE", "other", "Ünder", "ünder", f"only {i}"]) for i in range(150)]
    out = [(i, t, "d", "f", 1, 2, 3, "b", 4) for i, t in enumerate(texts)]
    return out + [out[20], out[20], (None, "same here", *out[0][2:]), (None, "alone", *out[0][2:]), (None, "Alone", *out[0][2:]), (None, None, *out[0][2:])]


def model(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(LOW), []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in ids:
            stays = left and i == keep
            left -= bool(stays)
            out.append((i, keep, len(ids), bool(stays), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df, digest=True):
    return sorted((tuple(r) if digest else tuple(r)[:4] for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_as_grouping_all_texts_in_one_batch_and_in_many(spark, rows, tmp_path):
    folder = str(tmp_path / "docs")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(folder)
    assert got(ed.dedup(spark, folder)) == model(rows)
    state = str(tmp_path / "state")
    ed.ingest(spark, folder, state, files_per_trigger=1)
    assert got(ed.resolve(spark, folder, state)) == model(rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ed._STORE["spark.sql.streaming.stateStore.providerClass"]


def test_a_stream_goes_on_from_its_state(spark, rows, tmp_path):
    folder, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame(rows[:70], SCHEMA).repartition(2).write.parquet(folder)
    ed.ingest(spark, folder, state)
    before = {r["digest"]: r["n"] for r in ed.held(spark, state).collect()}
    spark.createDataFrame(rows[70:], SCHEMA).repartition(3).write.mode("append").parquet(folder)
    ed.ingest(spark, folder, state)
    ed.ingest(spark, folder, state)  # nothing new
    after = {r["digest"]: r["n"] for r in ed.held(spark, state).collect()}
    assert before.keys() <= after.keys() and all(after[k] >= n for k, n in before.items()) and sum(after.values()) == len(rows)
    assert got(ed.resolve(spark, folder, state)) == model(rows)


def test_equal_digests_of_different_texts_are_told_apart_by_their_bytes(spark, rows, tmp_path):
    folder, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(folder)
    weak = lambda text: F.substring(ed.digest_of(text), 1, 1)
    ed.ingest(spark, folder, state, digest=weak)
    assert ed.held(spark, state).count() <= 16
    assert got(ed.resolve(spark, folder, state, digest=weak), False) == sorted((r[:4] for r in model(rows)), key=str)


def test_the_bitmap_only_keeps_rows_out(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(ed, "HIT_BITS", 1)
    folder = str(tmp_path / "docs")
    spark.createDataFrame(rows, SCHEMA).write.parquet(folder)
    assert got(ed.dedup(spark, folder)) == model(rows)


def test_empty_tables_and_folders(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    assert ed.dedup(spark, str(tmp_path / "none")).collect() == []


def test_no_python_in_the_plan(spark, rows, tmp_path):
    folder = str(tmp_path / "docs")
    spark.createDataFrame(rows, SCHEMA).write.parquet(folder)
    plan = ed.dedup(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
