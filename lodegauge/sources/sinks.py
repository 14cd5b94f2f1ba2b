"""Writers. Rows are written by tasks, also into files of an exact form (sources.exact); reports, which are one text, by the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegauge.sources import exact, scratch


def _driver_file(path: str, text: str) -> None:
    files, at = exact.store(path)
    files.create_dir(at.rpartition("/")[0] or "/", recursive=True)
    with files.open_output_stream(at) as f:
        f.write(text.encode("utf-8"))


def documents(docs: DataFrame, path: str) -> None:
    """A folder a document; names are escaped as paths need it."""
    docs.write.mode("overwrite").partitionBy("docid").json(path)


def export_documents(docs: DataFrame, folder: str) -> int:
    """One indented JSON file a document, named by its docid; their number."""
    value = F.to_json(F.struct("docid", "title", "text"), {"ignoreNullFields": "false"})
    return exact.write(docs, folder, F.concat("docid", F.lit(".json")), value, "object")


def json_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_json_array(rows: DataFrame, path: str) -> int:
    """One indented JSON array, in the order of rows; null fields are left out. The number of rows."""
    folder, _, name = path.rpartition("/")
    return exact.write(rows, folder or ".", F.lit(name), F.to_json(F.struct("*")), "array", needed=[name])


#: Strategies that a task writes side by side; where it meets more, it puts its rows in order first.
_SIDE_BY_SIDE = 64
#: Rows of a compressed file, which is one task's work to read, at most.
_FILE_ROWS = 200_000


def chunk_manifests(chunks: DataFrame, path: str, compression: str = "none") -> None:
    """JSON Lines by strategy; a strategy without chunks leaves no folder. Chunks are written by the tasks that make them: they hold all texts
    several times over, and are neither exchanged nor put in order. compression: one of Spark's codecs for JSON, as plain manifests took
    8.6 times the documents' Parquet files."""
    c = chunks.select("strategy", F.col("docid").alias("original_doc_id"), "chunk_id", "start", "end", "text")
    rows = c.write.mode("overwrite").partitionBy("strategy").option("compression", compression)
    if compression != "none":
        rows = rows.option("maxRecordsPerFile", _FILE_ROWS)
    with scratch.settings(chunks.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(_SIDE_BY_SIDE)}):
        rows.json(path)


def _lines(rows: DataFrame, line, order: list, path: str) -> None:
    """Sorted lines by strategy. Range partitioning by the sort key keeps files in order and of bounded size."""
    rows.repartitionByRange("strategy", *order).sortWithinPartitions("strategy", *order).select("strategy", line.alias("value")).write.mode("overwrite").partitionBy("strategy").text(path)


def qrels(judgments: DataFrame, path: str) -> None:
    """qid, 0, chunk_id, grade by tabs, sorted; nothing for strategies without rows."""
    _lines(judgments, F.concat_ws("\t", "qid", F.lit("0"), "chunk_id", F.col("rel").cast("string")), ["qid", "chunk_id"], path)


def runs(run: DataFrame, path: str) -> None:
    """qid, Q0, chunk_id, rank, score with 8 decimals, name by tabs, in order of rank."""
    score = F.format_string("%.8f", "score")
    _lines(run, F.concat_ws("\t", "qid", F.lit("Q0"), "chunk_id", F.col("rank").cast("string"), score, "run_name"), ["qid", "rank"], path)


def export_strategy_files(rows: DataFrame, folder: str, prefix: str, order: list | None = None) -> list[str]:
    """One text file a strategy ({prefix}_{strategy}.txt) from rows (strategy, value and the columns of order, which is
    that of the rows by default); the paths of such files."""
    exact.write(rows, folder, F.concat(F.lit(f"{prefix}_"), "strategy", F.lit(".txt")), F.col("value"), "lines", F.struct(*order) if order else None)
    return [f"{folder}/{name}" for name in exact.names(folder) if name.startswith(f"{prefix}_") and name.endswith(".txt")]


def conflicts(rows: DataFrame, path: str) -> None:
    """A line a conflict."""
    span = lambda k: F.concat(F.lit("["), F.col(f"start_{k}").cast("string"), F.lit("-"), F.col(f"end_{k}").cast("string"), F.lit("] "), f"logic_{k}", F.lit("/"), f"group_{k}", *([F.lit(" '"), F.coalesce(f"text_{k}", F.lit("")), F.lit("'")] if f"text_{k}" in rows.columns else []))
    line = F.concat(F.lit("qid="), "qid", F.lit(" docid="), "docid", F.lit(" iou="), F.format_string("%.4f", "iou"), F.lit(" "), span(1), F.lit(" | "), span(2))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def report(text: str, path: str) -> None:
    _driver_file(path, text)


def metadata(sheet: dict, input_path: str) -> str:
    """The sheet beside its input."""
    stem = input_path.rsplit(".", 1)[0] if "." in input_path.rpartition("/")[2] else input_path
    _driver_file(f"{stem}_metadata.json", json.dumps(sheet, indent=4))
    return f"{stem}_metadata.json"


def embeddings(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def exit_code(violations: DataFrame) -> int:
    """0 without violations, else 1."""
    return int(bool(violations.limit(1).count()))
