"""python -m lodegauge STEP FOLDER [...]: the steps of lodegauge.plans.steps from the command line."""

from __future__ import annotations

import argparse
import sys

from lodegauge.operators import documents
from lodegauge.plans import steps
from lodegauge.sources import readers, sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodegauge")
    p.add_argument("step", choices=["prepare", "questions", "annotate", "merge", "chunk", "align", "tune", "embed", "retrieve", "evaluate", "check-annotations", "check-chunks", "report", "unicode", "metadata"])
    p.add_argument("folder", help="the benchmark's folder; for unicode and metadata a file")
    p.add_argument("--raw", help="prepare: the raw text file")
    p.add_argument("--second", action="store_true", help="annotate: as the second annotator")
    p.add_argument("--strategy", action="append", help="chunk, tune: strategies")
    p.add_argument("--t-span", type=float, default=0.85)
    p.add_argument("--t-chunk", type=float, default=0.50)
    p.add_argument("-k", type=int, default=20)
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lodegauge").getOrCreate()
    if a.step in ("check-annotations", "check-chunks"):
        bad = steps.check_annotations(spark, a.folder) if a.step == "check-annotations" else steps.check_chunks(spark, a.folder)
        bad.show(50, False)
        return sinks.exit_code(bad)
    if a.step in ("tune", "evaluate"):
        (steps.tune(spark, a.folder, (a.strategy or ["SENT"])[0]) if a.step == "tune" else steps.evaluate(spark, a.folder)).show(100, False)
        return 0
    run = {
        "prepare": lambda: steps.prepare(spark, a.raw, a.folder), "questions": lambda: steps.questions(spark, a.folder), "annotate": lambda: steps.annotations(spark, a.folder, a.second),
        "merge": lambda: steps.merge(spark, a.folder), "chunk": lambda: steps.chunk(spark, a.folder, a.strategy), "align": lambda: steps.align(spark, a.folder, a.t_span, a.t_chunk),
        "embed": lambda: steps.embed(spark, a.folder), "retrieve": lambda: steps.retrieve(spark, a.folder, a.k), "report": lambda: steps.report(spark, a.folder), "metadata": lambda: steps.sheet(spark, a.folder),
        "unicode": lambda: documents.unicode_report(documents.unicode_scan(readers.whole_text(spark, a.folder).selectExpr("'file' as docid", "text"))),
    }
    print(run[a.step]())
    return 0


if __name__ == "__main__":
    sys.exit(main())
