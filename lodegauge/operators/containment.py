"""Every occurrence of many passages in many documents, through an index of the passages' rarest pieces.

The join of locate_span() over a whole corpus: no passage is compared with a document that does not hold a rare piece of it.

1. Passages are cleaned as locate_span() cleans snippets and given the same variants, each once (without regard to case).
2. One scan of the documents counts the pieces of Q bytes that passages hold; each variant is filed under its rarest one, with
   that piece's place in it. A variant shorter than Q bytes is filed under its first 4, 2 or 1 bytes.
3. A second scan looks every place of a document up in the index, which is a table of flags and a sorted array, and compares
   the whole variant with the text where a piece is found.

Only passages leave the driver, PASSAGE_BYTES of them at a time (one at least), each block with two scans; what a task holds is
bounded by that and a block of text. Nothing of the documents is exchanged but sums and hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from lodegauge.functions.text import normalized, small
from lodegauge.operators.spans import snippet_core, snippet_variants
from lodegauge.sources import scratch

#: Bytes of a piece, for variants that are so long.
Q = 8
PASSAGE_BYTES = 4 << 20
BLOCK = 1 << 20
_FLAG_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place, as a little-endian number; zeros follow the last."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf),), "<u8", padded, strides=(1,))


def _mask(q: int) -> np.uint64:
    return np.uint64((1 << 8 * q) - 1)


class Pieces:
    """Sorted numbers that are looked up at every place of a text."""

    def __init__(self, values: np.ndarray, q: int):
        self.values, self.mask = values, _mask(q)
        self.flags = np.zeros(1 << _FLAG_BITS, bool)
        self.flags[self._flag(values)] = True

    @staticmethod
    def _flag(x: np.ndarray) -> np.ndarray:
        return x * _SPREAD >> np.uint64(64 - _FLAG_BITS)

    def find(self, eight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, and the numbers of the values there."""
        x = eight & self.mask
        at = np.flatnonzero(self.flags[self._flag(x)])
        number = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        hit = self.values[number] == x[at]
        return at[hit], number[hit]


def _size(length: int) -> int:
    return next(q for q in (Q, 4, 2, 1) if q <= length)


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about BLOCK bytes, or one row."""
    col = batch.column(column).cast(pa.large_binary())
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK, side="right")) - 1)
        yield a, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def _counts(docs: DataFrame, grams: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each of the pieces of each size occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {q: Pieces(v, q) for q, v in grams.items()}
        sums = {q: np.zeros(len(v), np.int64) for q, v in grams.items()}
        for batch in small(batches):
            for _, buf, _ in _blocks(batch, 0):
                eight = _eight(buf)
                for q, pieces in known.items():
                    sums[q] += np.bincount(pieces.find(eight)[1], minlength=len(sums[q]))
        for q, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q, np.int32)), pa.array(some), pa.array(n[some])], names=["q", "i", "n"])

    out = {q: np.zeros(len(v), np.int64) for q, v in grams.items()}
    for r in docs.select("low").mapInArrow(run, "q int, i long, n long").groupBy("q", "i").agg(F.sum("n").alias("n")).toLocalIterator():  # at most a row a piece
        out[r["q"]][r["i"]] = r["n"]
    return out


class Index:
    """Variants by their rarest pieces. variants: (passage, number, bytes)."""

    def __init__(self, variants: list[tuple[int, int, bytes]]):
        self.variants = variants
        by_size: dict[int, list[np.ndarray]] = {}
        for _, _, v in variants:
            q = _size(len(v))
            eight = _eight(np.frombuffer(v, np.uint8)) & _mask(q)
            by_size.setdefault(q, []).append(eight[: len(v) - q + 1] if q == Q else eight[:1])
        self.grams = {q: np.unique(np.concatenate(parts)) for q, parts in by_size.items()}

    def file(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each variant's piece."""
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = {q: {} for q in self.grams}
        for k, (_, _, v) in enumerate(self.variants):
            q = _size(len(v))
            eight = _eight(np.frombuffer(v, np.uint8)) & _mask(q)
            eight = eight[: len(v) - q + 1] if q == Q else eight[:1]
            at = int(np.argmin(counts[q][np.searchsorted(self.grams[q], eight)]))
            chosen[q].setdefault(int(eight[at]), []).append((k, at))
        self.filed = {q: (Pieces(np.array(sorted(c), np.uint64), q), [c[g] for g in sorted(c)]) for q, c in chosen.items()}

    def hits(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, variant, place in the bytes) of all occurrences, which may overlap."""
        whole, eight = buf.tobytes(), _eight(buf)
        for pieces, filed in self.filed.values():
            places, numbers = pieces.find(eight)
            rows = np.searchsorted(off, places, side="right") - 1
            for place, number, row in zip(places.tolist(), numbers.tolist(), rows.tolist()):
                for k, at in filed[number]:
                    v = self.variants[k][2]
                    begin = place - at
                    if begin >= off[row] and begin + len(v) <= off[row + 1] and whole.startswith(v, begin):
                        yield row, k, begin


def _schema(kind: DataType) -> str:
    return f"passage_id {kind.simpleString()}, docid string, variant int, occurrence long, start long, end long, span_text string"


def _search(docs: DataFrame, index: Index, names: list, kind: DataType, snap: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out: list[tuple] = []
            for first, buf, off in _blocks(batch, 1):
                found: dict[tuple[int, int], dict[int, list[int]]] = {}
                for row, k, begin in index.hits(buf, off):
                    passage, number, _ = index.variants[k]
                    found.setdefault((row, passage), {}).setdefault(number, []).append((begin, k))
                for (row, passage), by_number in sorted(found.items()):
                    number = min(by_number)
                    docid, text = batch.column(0)[first + row].as_py(), batch.column(2)[first + row].as_py()
                    # characters up to each place: bytes that go on a character do not count
                    places = sorted(by_number[number])
                    starts = np.cumsum((buf[off[row] : off[row + 1]] & 0xC0) != 0x80)
                    for n, (begin, k) in enumerate(places, 1):
                        begin -= int(off[row])
                        start = int(starts[begin]) - 1
                        end = start + len(index.variants[k][2].decode("utf-8", "surrogatepass"))
                        if snap:
                            start = text.rfind(" ", 0, start) + 1
                            after = text.find(" ", end)
                            end = after if after >= 0 else len(text)
                        out.append((names[passage], docid, number, n, start, end, text[start:end]))
            if out:
                columns = list(zip(*out))
                types = [to_arrow_type(kind), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["passage_id", "docid", "variant", "occurrence", "start", "end", "span_text"])

    return docs.select("docid", "low", "text").mapInArrow(run, _schema(kind))


def occurrences(passages: DataFrame, docs: DataFrame, snap: bool = True) -> DataFrame:
    """passage_id, docid, variant, occurrence, start, end, span_text: every place of every document (docid, text) where a
    passage (passage_id, text) occurs, without regard to case; in each document by the first of its variants that occurs there,
    whose number is given (from 1). Occurrences are numbered from the left and may overlap; they reach outwards to white
    space if ``snap``.

    Null and empty texts hold nothing and occur nowhere, nor do passages of marks alone; rows of one docid or passage_id are
    each judged by themselves. Offsets are those of normalize_offsets()."""
    spark, kind = docs.sparkSession, passages.schema["passage_id"].dataType
    core = passages.select("passage_id", snippet_variants(snippet_core(F.col("text").cast("string"))).alias("v"))
    core = scratch.written(core.select("passage_id", F.transform("v", lambda x: F.lower(x)).alias("v")).where(F.size("v") > 0), "passages")
    normal = normalized(docs.select(F.col("docid").cast("string").alias("docid"), F.col("text").cast("string").alias("text"))).where("text <> ''")
    texts = normal.select("docid", F.lower("text").alias("low"), "text")
    blocks = max(1, -(-(core.agg(F.sum(F.octet_length(F.array_join("v", "")))).first()[0] or 0) // PASSAGE_BYTES))
    out = spark.createDataFrame([], _schema(kind))
    for b in range(blocks):
        rows = core.where(F.pmod(F.xxhash64("v"), F.lit(blocks)) == b).collect()  # about PASSAGE_BYTES
        variants = []
        for i, r in enumerate(rows):
            seen: dict[bytes, int] = {}
            for number, v in enumerate(r["v"], 1):
                seen.setdefault(v.encode("utf-8", "surrogatepass"), number)
            variants += [(i, number, v) for v, number in seen.items()]
        if variants:
            index = Index(variants)
            index.file(_counts(texts, index.grams))
            out = out.unionByName(_search(texts, index, [r["passage_id"] for r in rows], kind, snap))
    return out
