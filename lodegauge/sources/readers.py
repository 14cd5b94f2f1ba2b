"""Readers with explicit schemas. Malformed records are kept in _corrupt_record, never dropped silently."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodegauge.operators import metrics
from lodegauge.sources import exact, schemas, scratch


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file (text), line ends as \\n."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str = schemas.CHUNK) -> DataFrame:
    """One row a line; a line that is no JSON has its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of the lines of text files that are not empty; line_no counts all lines of a file from 1.

    Files are read in splits, twice: first lines are counted a split, then a split's lines are numbered from the sum of those
    before it. Both scans must cut files alike. If they do not (another number of cores changes that), some line falls
    outside its split's count, and the job fails."""
    m = F.col("_metadata")
    lines = spark.read.text(path).select(m["file_path"].alias("path"), m["file_name"].alias("file"), m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    counted = lines.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = scratch.lookup(scratch.written(counted.select("path", "split", "n", "first", before.alias("before")), "splits"))
    place = F.col("at") - F.col("first")
    number = F.when((place >= 0) & (place < F.col("n")), F.col("before") + place + 1).otherwise(F.raise_error(F.lit("files were cut otherwise than when their lines were counted")).cast("long"))
    found = lines.join(splits, ["path", "split"], "left").withColumn("line_no", number)
    return found.where("value <> '' and line_no > 0").select("file", "line_no", "value")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text files of any size, which are read in splits; line_no is no number, but orders the
    lines of a file: the split's start, then the line's place."""
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"))
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), place.alias("line_no"), "value").where("value <> ''")


def json_lines_checked(spark: SparkSession, path: str, schema: str = schemas.CHUNK) -> DataFrame:
    """Lines with their numbers, parsed fields, and _corrupt_record for those that are no JSON."""
    lines = numbered_lines(spark, path)
    fields = F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select("file", "line_no", fields.alias("r")).select("file", "line_no", "r.*")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def _strategy_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    return ordered_lines(spark, path).select(F.regexp_extract("file", name, 1).alias("strategy"), "line_no", "value")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgments of qrels_{strategy}.txt files."""
    return metrics.parse_qrels(_strategy_lines(spark, path, r"^qrels_(.*)\.txt"))


def _run_files(spark: SparkSession, path: str, run_name: str) -> DataFrame:
    """strategy, file, and its place among the strategy's files by name, of those that are named run_{name}_{strategy}.txt."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"))
    named = files.select(F.regexp_extract("file", rf"^run_(?:{run_name})_(.*)\.txt$", 1).alias("strategy"), "file").where("strategy <> ''")
    return named.withColumn("place", F.row_number().over(Window.partitionBy("strategy").orderBy("file")))


def runs(spark: SparkSession, path: str, run_name: str = r"[^_]+") -> DataFrame:
    """Runs of run_{name}_{strategy}.txt files. Of several files of one strategy the first by name counts; ambiguous_runs()
    tells the others, and run_name, a pattern, tells them apart."""
    first = scratch.lookup(scratch.written(_run_files(spark, path, run_name).where("place = 1").select("strategy", "file"), "runs"))
    lines = ordered_lines(spark, path).join(first, "file").select("strategy", "line_no", "value")
    return metrics.parse_run(lines)


def ambiguous_runs(spark: SparkSession, path: str, run_name: str = r"[^_]+") -> DataFrame:
    """strategy and file of the runs that runs() leaves out, since another of their strategy comes first."""
    return _run_files(spark, path, run_name).where("place > 1").select("strategy", "file")


def embeddings_npz(spark: SparkSession, path: str) -> DataFrame:
    """ids, docids and embeddings of .npz files, a file at a time in a task."""

    def load(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for b in batches:
            for content in b.column(0).to_pylist():
                z = np.load(io.BytesIO(content), allow_pickle=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(z["ids"].astype(str)), pa.array(z["docids"].astype(str)), pa.array(list(z["embeddings"].astype(np.float32)), pa.list_(pa.float32()))], names=["chunk_id", "docid", "embedding"]
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(load, schemas.EMBEDDING)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def packed(sizes: list[tuple[str, int]], limit: int, open_cost: int) -> list[list[str]]:
    """Paths in runs of up to ``limit`` bytes (one file at least), a file counting for ``open_cost`` more."""
    out: list[list[str]] = []
    held = 0
    for path, size in sizes:
        cost = size + open_cost
        if not out or held + cost > limit:
            out.append([])
            held = 0
        out[-1].append(path)
        held += cost
    return out


class JsonDocuments(DataSource):
    """One JSON object a file, sorted by name; a task reads many small files. File names may contain colons, which Hadoop's
    paths do not allow, so files are listed and opened through pyarrow.fs. Options: path (the folder), packed_bytes and
    open_cost (what a task reads at most, and what opening a file counts for)."""

    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def schema(self) -> str:
        return schemas.DOCUMENT + (", load_error string" if self.options.get("checked") else "")

    def reader(self, schema):  # noqa: ARG002
        return JsonDocumentsReader(self.options)


class JsonDocumentsReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.checked = options["path"], bool(options.get("checked"))
        self.limit, self.open_cost = int(options.get("packed_bytes", 32 << 20)), int(options.get("open_cost", 64 << 10))

    def partitions(self):
        from pyarrow import fs

        files, root = exact.store(self.folder)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        mine = sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".json"))
        return [_Files(paths) for paths in packed(mine, self.limit, self.open_cost)]

    def read(self, partition) -> Iterator[tuple]:
        files, _ = exact.store(self.folder)
        for path in partition.paths:
            try:
                with files.open_input_stream(path) as f:
                    doc = json.loads(f.read().decode("utf-8"))
                row = (doc.get("docid"), doc.get("title"), doc.get("text"))
            except (ValueError, AttributeError, OSError) as e:
                if not self.checked:
                    raise
                yield (path.rpartition("/")[2].removesuffix(".json"), None, None, str(e))
                continue
            yield (*row, None) if self.checked else row


def json_documents(spark: SparkSession, folder: str, checked: bool = False) -> DataFrame:
    """Documents of a folder. A file that can't be read fails the job; checked: it is a row with its name as docid and the
    reason in load_error instead."""
    spark.dataSource.register(JsonDocuments)
    read = spark.read.format("json_documents").option("path", folder)
    return (read.option("checked", "true") if checked else read).load()


def questions_or_file(spark: SparkSession, view: str, path: str) -> DataFrame:
    """This session's questions if there are any, else those of the file."""
    if spark.catalog.tableExists(view):
        return spark.table(view)
    return json_array(spark, path, schemas.QUESTION).withColumn("group", F.coalesce("group", F.lit("g1")))
