"""Text expressions over columns. Offsets count code points from 0 and intervals are half open."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white-space characters of the offset space, spelt out, as engines differ on \\s (fixed values).
SPACE = r"\t\n\x0b\x0c\r\x1c-\x20\x85\xa0  -     　"
#: The same one by one.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))
#: The same for DuckDB's regular expressions.
SPACE_SQL = r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Curly quotes and dashes and what stands for them (fixed values).
CURLY, PLAIN = "’‘”“—–", "''\"\"--"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(SPACES))


def normalize_offsets(c: Column) -> Column:
    """The text that all offsets refer to: plain quotes and dashes, one space for any white space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(c, CURLY, PLAIN), f"[{SPACE}]+", " "))


#: Bytes of a batch that is worked on at once.
SMALL = 1 << 22


def small(batches: Iterable[pa.RecordBatch], size: int = SMALL) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes: Spark counts a batch's rows, however long their texts are."""
    for b in batches:
        rows = max(1, b.num_rows * size // max(b.nbytes, 1))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def plain_text(text: str) -> str:
    """normalize_offsets() of one text; str.split() splits at the same white space."""
    if not text.isascii():
        for a, b in zip(CURLY, PLAIN):
            text = text.replace(a, b)
    return " ".join(text.split())


def normalized(rows: DataFrame, column: str = "text") -> DataFrame:
    """rows with normalize_offsets() of their texts, in one Arrow pass: as a column expression it would be computed again by every
    filter and projection that the planner moves beneath it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at = b.schema.get_field_index(column)
            yield b.set_column(at, column, pa.array([None if t is None else plain_text(t) for t in b.column(at).to_pylist()], pa.string()))

    return rows.mapInArrow(run, rows.schema)


def text_slice(c: Column, start: Column, end: Column) -> Column:
    """c[start:end] for 0 <= start."""
    return F.substring(c, start.cast("int") + 1, F.greatest(end.cast("int") - start.cast("int"), F.lit(0)))


def nfc(c: Column) -> Column:
    """Canonical composition; only rows with characters beyond ASCII go to Python, in Arrow batches, of which few texts are Python's
    strings at a time."""

    @F.arrow_udf("string")
    def compose(texts: pa.Array) -> pa.Array:
        parts = [pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.slice(at, 64).to_pylist()], pa.string()) for at in range(0, len(texts), 64)]
        return pa.concat_arrays(parts) if parts else texts

    return F.when(c.rlike(r"[^\x00-\x7f]"), compose(c)).otherwise(c)


def normalize_corpus(c: Column) -> Column:
    """Corpus cleaning: NFC, typographic characters to plain ones, runs of spaces and tabs to a space, \\n line ends."""
    plain = F.translate(nfc(c), "“”‘’– •™﻿", "\"\"''- *")
    plain = F.replace(F.replace(plain, F.lit("—"), F.lit(" -- ")), F.lit("…"), F.lit("..."))
    return F.regexp_replace(F.regexp_replace(plain, r"[ \t]+", " "), r"\r\n?", "\n")
