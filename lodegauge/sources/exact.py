"""Files of an exact form and name, written by tasks: one text, JSON array or JSON object a file.

Rows are (file, value, place). They are dealt to tasks by file and come in order of place, so a file is streamed by one task and
files are written side by side; no row passes the driver. A task writes into a folder of its job beside the files, under
names of its own attempt, and tells which file each is to be. Only when all tasks are done are the files moved to their
places; what other attempts left behind goes with the folder, and a failed job leaves nothing.

Names may contain any character that the store allows, colons too: files are opened through pyarrow.fs, not through Hadoop's
paths. A folder is a local path or a URI. No rows, no file; ``needed`` names those that are there even so, as an empty array
(or an empty text).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Before the first value, between two, and after the last one, by form.
FORMS = {"lines": ("", "\n", "\n"), "array": ("[\n", ",\n", "\n]"), "object": ("", "\n", "")}


def store(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def names(folder: str) -> list[str]:
    """The files of a folder, sorted."""
    from pyarrow import fs

    files, root = store(folder)
    return sorted(f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file)


def _shown(value: str, form: str) -> str:
    """JSON with an indent of two."""
    if form == "lines":
        return value
    text = json.dumps(json.loads(value), indent=2, ensure_ascii=False)
    return "\n".join("  " + line for line in text.split("\n")) if form == "array" else text


@dataclass
class Written(WriterCommitMessage):
    """(temporary name, name) of a task's files."""

    files: list[tuple[str, str]]


class ExactFiles(DataSource):
    """Options: path, form, job (the name of the job's folder), needed (a JSON array of names)."""

    @classmethod
    def name(cls) -> str:
        return "exact_files"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite):  # noqa: ARG002
        return ExactWriter(self.options["path"], self.options["form"], self.options["job"], json.loads(self.options.get("needed", "[]")))


class ExactWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, form: str, job: str, needed: list[str] | tuple = ()):
        self.folder, self.form, self.job, self.needed = folder.rstrip("/"), form, job, list(needed)

    def _places(self):
        files, root = store(self.folder)
        return files, root, f"{root}/_{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, temporary = self._places()
        before, between, after = FORMS[self.form]
        attempt = f"{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}-{uuid.uuid4().hex}"
        done, out, current = [], None, None
        try:
            for batch in iterator:
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if name != current:
                        if out:
                            out.write(after.encode())
                            out.close()
                        files.create_dir(temporary, recursive=True)
                        done.append((f"{attempt}-{len(done)}", name))
                        out, current = files.open_output_stream(f"{temporary}/{done[-1][0]}"), name
                        out.write(before.encode())
                    else:
                        out.write(between.encode())
                    out.write(_shown(value, self.form).encode("utf-8"))
            if out:
                out.write(after.encode())
        finally:
            if out:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root, temporary = self._places()
        moves = [f for m in messages if m for f in m.files]
        files.create_dir(root, recursive=True)
        for folder in {f"{root}/{name}".rpartition("/")[0] for _, name in moves} - {root}:
            files.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: files.move(f"{temporary}/{f[0]}", f"{root}/{f[1]}"), moves))
        for name in set(self.needed) - {name for _, name in moves}:
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(b"[]" if self.form == "array" else b"")
        self._clear(files, temporary)

    def abort(self, messages: list[Written | None]) -> None:  # noqa: ARG002
        files, _, temporary = self._places()
        self._clear(files, temporary)

    @staticmethod
    def _clear(files, temporary: str) -> None:
        from pyarrow import fs

        if files.get_file_info(temporary).type == fs.FileType.Directory:
            files.delete_dir(temporary)


def write(rows: DataFrame, folder: str, file: Column, value: Column, form: str = "lines", place: Column | None = None, needed: list[str] | tuple = ()) -> int:
    """Write value into file, in order of place (by default the order of rows); the number of rows. Files that are there already are
    replaced, others of the folder are left alone."""
    rows.sparkSession.dataSource.register(ExactFiles)
    seen = Observation()
    place = F.monotonically_increasing_id() if place is None else place
    ordered = rows.select(file.alias("file"), value.alias("value"), place.alias("place")).repartition("file").sortWithinPartitions("file", "place")
    out = ordered.select("file", "value").observe(seen, F.count("*").alias("n")).write.format("exact_files").mode("append")
    out.option("form", form).option("job", f"writing-{uuid.uuid4().hex}").option("needed", json.dumps(list(needed))).option("path", folder).save()
    return seen.get["n"]
