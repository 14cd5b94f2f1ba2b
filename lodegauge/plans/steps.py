"""The steps of building and scoring a benchmark, over folders: each reads what the one before wrote.

Layout under a folder: documents/, questions.json, annotations_1.json, annotations_2.json, merged.json, chunks/,
qrels/, embeddings/, runs/. All rows are written by tasks; the report and the sheet, one text each, by the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegauge.operators import alignment, annotate, checks, chunking, documents, metadata, metrics, retrieval, spans
from lodegauge.sources import readers, schemas, sinks

FIRST, SECOND = "annotator_1", "annotator_2"


def prepare(spark: SparkSession, raw: str, folder: str, prefix: str = "doc:ch") -> int:
    """A raw text file to cleaned documents by section; their number."""
    from lodegauge.functions.text import normalize_corpus

    text = readers.whole_text(spark, raw).select(normalize_corpus(F.col("text")).alias("text"))
    return sinks.export_documents(documents.split_sections(documents.extract_main_text(text), prefix), f"{folder}/documents")


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    return readers.json_documents(spark, f"{folder}/documents")


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    rows = readers.json_array(spark, path, schemas.ANNOTATION)
    return rows.where("_corrupt_record is null").drop("_corrupt_record").withColumn("src_ord", F.monotonically_increasing_id())


def questions(spark: SparkSession, folder: str, generator: Callable[[], annotate.Generator] = annotate.offline_generator) -> int:
    return sinks.export_json_array(annotate.generate_questions(load_documents(spark, folder), generator), f"{folder}/questions.json")


def annotations(spark: SparkSession, folder: str, second: bool = False, generator: Callable[[], annotate.Generator] = annotate.offline_generator) -> int:
    q = readers.questions_or_file(spark, "lodegauge_questions", f"{folder}/questions.json")
    rows = annotate.annotate(q, load_documents(spark, folder), SECOND if second else FIRST, generator, fences=second)
    return sinks.export_json_array(rows, f"{folder}/annotations_{2 if second else 1}.json")


def _both(spark: SparkSession, folder: str) -> DataFrame:
    """Both annotators; a file that is missing is left out."""
    found = []
    for k, name in ((1, FIRST), (2, SECOND)):
        try:
            found.append((load_annotations(spark, f"{folder}/annotations_{k}.json").drop("src_ord"), name))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spans.with_order([a for a, _ in found], [n for _, n in found])


def merge(spark: SparkSession, folder: str) -> int:
    rows, docs = _both(spark, folder), load_documents(spark, folder)
    sinks.conflicts(spans.merge_conflicts(rows, docs), f"{folder}/conflicts")
    merged = spans.merge_spans(rows, docs).drop("contributors").orderBy("qid", "docid", "start", "end")
    return sinks.export_json_array(merged, f"{folder}/merged.json")


def chunk(spark: SparkSession, folder: str, strategies: list[str] | None = None) -> None:
    some = {k: v for k, v in chunking.STRATEGIES.items() if not strategies or k in strategies}
    sinks.chunk_manifests(chunking.chunk_all(load_documents(spark, folder), some), f"{folder}/chunks")


def load_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = readers.json_lines(spark, f"{folder}/chunks", schemas.CHUNK + ", strategy string")
    return rows.where("_corrupt_record is null").withColumnRenamed("original_doc_id", "docid").drop("_corrupt_record")


def align(spark: SparkSession, folder: str, t_span: float = alignment.T_SPAN, t_chunk: float = alignment.T_CHUNK) -> list[str]:
    """All strategies at once; one file a strategy with rows."""
    q = alignment.align(load_annotations(spark, f"{folder}/merged.json"), load_chunks(spark, folder), t_span, t_chunk, bucket=4096)
    lines = q.withColumn("value", F.concat_ws("\t", "qid", F.lit("0"), "chunk_id", F.col("rel").cast("string")))
    return sinks.export_strategy_files(lines, f"{folder}/qrels", "qrels", ["qid", "chunk_id"])


def tune(spark: SparkSession, folder: str, strategy: str) -> DataFrame:
    pairs = alignment.overlapping_pairs(load_annotations(spark, f"{folder}/merged.json"), load_chunks(spark, folder).where(F.col("strategy") == strategy), bucket=4096)
    return alignment.threshold_best(alignment.threshold_grid(pairs))


def embed(spark: SparkSession, folder: str, encoder: Callable = retrieval.hashed_encoder) -> None:
    sinks.embeddings(retrieval.embed(load_chunks(spark, folder).select("strategy", "chunk_id", "docid", "text"), encoder).drop("text"), f"{folder}/embeddings")


def retrieve(spark: SparkSession, folder: str, k: int = 20, run_name: str = "dense", encoder: Callable = retrieval.hashed_encoder) -> list[str]:
    """A run of every strategy: questions are embedded once."""
    q = retrieval.embed(readers.questions_or_file(spark, "lodegauge_questions", f"{folder}/questions.json").select("qid", "question"), encoder, text="question")
    vectors, out = spark.read.parquet(f"{folder}/embeddings"), None
    for s in [r[0] for r in vectors.select("strategy").distinct().orderBy("strategy").collect()]:
        one = retrieval.as_run(retrieval.retrieve(q, vectors.where(F.col("strategy") == s), k), f"{run_name}_{s}").withColumn("strategy", F.lit(s))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return []
    line = F.concat_ws("\t", "qid", "q0", "chunk_id", F.col("rank").cast("string"), F.format_string("%.8f", "score"), "run_name")
    return sinks.export_strategy_files(out.withColumn("value", line), f"{folder}/runs", f"run_{run_name}", ["qid", "rank"])


def evaluate(spark: SparkSession, folder: str, run_name: str = "dense") -> DataFrame:
    for r in readers.ambiguous_runs(spark, f"{folder}/runs", run_name).collect():  # a row a file
        warnings.warn(f"{r['file']} is left out: another run of {r['strategy']} comes first", stacklevel=2)
    return metrics.summary(readers.runs(spark, f"{folder}/runs", run_name), readers.qrels(spark, f"{folder}/qrels")).orderBy("strategy")


def check_annotations(spark: SparkSession, folder: str) -> DataFrame:
    q = readers.json_array(spark, f"{folder}/questions.json", schemas.QUESTION)
    docs, out = readers.json_documents(spark, f"{folder}/documents", checked=True), None
    for k, name in ((1, FIRST), (2, SECOND)):
        path = f"{folder}/annotations_{k}.json"
        try:
            one = checks.check_annotations(q, load_annotations(spark, path), docs, name)
        except Exception as e:  # noqa: BLE001
            one = spark.createDataFrame([checks.file_violation(path, None if "PATH_NOT_FOUND" in str(e) else str(e)[:200])], schemas.VIOLATION)
        out = one if out is None else out.unionByName(one)
    return out


def check_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return checks.check_chunks(readers.json_lines(spark, f"{folder}/chunks"), load_documents(spark, folder))


def report(spark: SparkSession, folder: str) -> str:
    q = readers.json_array(spark, f"{folder}/questions.json", schemas.QUESTION).withColumn("src_ord", F.monotonically_increasing_id())
    text = checks.distribution_report(q, load_annotations(spark, f"{folder}/merged.json"))
    sinks.report(text, f"{folder}/output_distribution.md")
    return text


def sheet(spark: SparkSession, path: str) -> str:
    """The metadata sheet of a .csv or .json file, beside it."""
    name = path.rpartition("/")[2]
    made = metadata.table_metadata(readers.csv_table(spark, path), name) if path.endswith(".csv") else metadata.json_metadata(spark.read.option("multiLine", True).json(path), name)
    return sinks.metadata(made, path)
