"""The steps from a raw text to a table of metrics, each from what the one before wrote."""

from lodegauge.plans import steps
from lodegauge.sources import readers


def test_from_raw_text_to_metrics(spark, tmp_path):
    body = lambda a: " ".join(f"The {a} number {i} went over the hill. It was “late” — very late…" for i in range(60))
    (tmp_path / "raw.txt").write_text(f"license\nCHAPTER I. One\n{body('fox')}\nCHAPTER II.\nTwo\n{body('hare')}\nTHE END\nmore\n", encoding="utf-8")
    f = str(tmp_path)
    assert steps.prepare(spark, f"{f}/raw.txt", f) == 2
    assert sorted(r["docid"] for r in steps.load_documents(spark, f).collect()) == ["doc:ch01", "doc:ch02"]
    assert steps.questions(spark, f) > 4
    assert steps.annotations(spark, f) > 0 and steps.annotations(spark, f, second=True) > 0
    assert steps.check_annotations(spark, f).count() == 0
    assert steps.merge(spark, f) > 0
    steps.chunk(spark, f)
    assert steps.check_chunks(spark, f).count() == 0
    files = steps.align(spark, f, 0.85, 0.02)
    assert any("CHARWIN500_OV50" in x for x in files)
    assert steps.tune(spark, f, "SENT").first()["n"] > 0
    steps.embed(spark, f)
    assert len(steps.retrieve(spark, f)) == 4
    table = {r["strategy"]: r for r in steps.evaluate(spark, f).collect()}
    assert len(table) == len(files) and all(0 <= r["map"] <= 1 and r["num_ret"] > 0 for r in table.values())
    assert "## Overall Summary" in steps.report(spark, f) and (tmp_path / "output_distribution.md").exists()
    assert steps.sheet(spark, f"{f}/questions.json").endswith("questions_metadata.json")
    (tmp_path / "annotations_2.json").unlink()
    assert [r["code"] for r in steps.check_annotations(spark, f).collect()] == ["ANNOTATION_FILE_NOT_FOUND"]
    assert readers.runs(spark, f"{f}/runs", "dense").select("strategy").distinct().count() == 4
