"""Line numbers of files that many tasks read."""

import random

import pytest

from lodegauge.sources import readers


@pytest.fixture()
def small_splits(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "4096"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


def test_numbers_are_those_of_the_whole_files(spark, tmp_path, small_splits):
    rng = random.Random(2)
    want = []
    for name, n, end in (("big.txt", 3000, "\n"), ("crlf.txt", 400, "\r\n"), ("one.txt", 1, ""), ("none.txt", 0, ""), ("long.txt", 3, "\n"), ("blank.txt", 50, "\n")):
        lines = ["" if name == "blank.txt" or rng.random() < 0.1 else "é" * rng.randrange(1, 40) + str(i) for i in range(n)]
        if name == "long.txt":
            lines = ["x" * 30_000, "y", "z" * 9000]
        (tmp_path / name).write_bytes((end.join(lines) + end).encode())
        want += [(name, i, line) for i, line in enumerate(lines, 1) if line]
    got = readers.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 10
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_other_splits_than_those_counted_end_the_job(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(4000)))
    got = readers.numbered_lines(spark, str(tmp_path))
    assert got.count() == 4000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    with pytest.raises(Exception, match="cut otherwise"):
        got.where("line_no > 0").collect()


def test_broken_lines_have_their_numbers(spark, tmp_path, small_splits):
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "c1"}\n\nnot json\n{"chunk_id": "c2"}\n' * 900)
    rows = readers.json_lines_checked(spark, str(tmp_path), "chunk_id string").collect()
    assert {(r["line_no"] % 4, r["chunk_id"], r["_corrupt_record"]) for r in rows} == {(1, "c1", None), (3, None, "not json"), (0, "c2", None)}
    assert len(rows) == 2700 and max(r["line_no"] for r in rows) == 3600
