"""An encoder that is fitted on the corpus: latent directions of its words, by a randomized singular value decomposition.

Words are hashed to ``buckets`` columns, so the matrix of documents (rows of tf-idf weights, of unit length) has a bounded width
whatever the vocabulary. Its leading right singular vectors are found as Halko, Martinsson and Tropp (2011) describe: a random
sketch is multiplied by the matrix and its transpose, a few times. Each product is one pass over sparse rows, which every task
sums by itself into a block of buckets x directions; the blocks are summed by ranges of buckets, and only their sum, whose size
is fixed by the parameters, comes to the driver to be made orthogonal. No document's row leaves its task. A pass has as many tasks as
the cluster has cores, so what is exchanged grows with the cluster and not with the corpus; rows are multiplied one by one, as the
few directions of one document's words stay in a core's cache.

A text's vector is its weights times the directions, scaled to unit length. Fitted twice on the same rows, directions agree up to
rounding: signs are fixed by each direction's greatest component.

Null and empty texts have zero vectors and do not count as documents. An empty corpus gives directions of zeros. Words are what
white space separates, in lower case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from lodegauge.functions.text import small
from lodegauge.sources import scratch

#: Buckets of a row in which partial products are exchanged.
RANGE = 1024
#: Columns of sparse rows.
BUCKET, N = "__bucket", "__n"


def bucket(word: str, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % buckets


def _buckets(words: pa.StringArray, buckets: int) -> np.ndarray:
    """bucket() of words, whose bytes are hashed where they lie; -1 for the empty word."""
    _, places, data = words.buffers()
    at = np.frombuffer(places, np.int32, len(words) + 1, words.offset * 4)
    data, at_ = memoryview(data or b""), at.tolist()
    found = b"".join([hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(at_, at_[1:])])
    return np.where(np.diff(at) > 0, (np.frombuffer(found, "<u8") % np.uint64(buckets)).astype(np.int64), -1)


def sparse(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, bucket and number of the words of texts, in order of row and bucket."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    words, row = lists.flatten().dictionary_encode(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    column = _buckets(words.dictionary, buckets)[words.indices.to_numpy()] if len(row) else row
    key, n = np.unique((row * buckets + column)[column >= 0], return_counts=True)
    return key // buckets, key % buckets, n


@dataclass
class Fitted:
    """idf by bucket; directions (buckets x dim) with their singular values."""

    idf: np.ndarray
    directions: np.ndarray
    values: np.ndarray

    def __call__(self) -> Callable[[list[str]], np.ndarray]:
        """A maker of encoders, for retrieval.embed()."""

        def encode(texts: list[str]) -> np.ndarray:
            row, column, n = sparse(pa.array(texts, pa.string()), len(self.idf))
            return _unit(_product(row, column, _weights(row, column, n, self.idf), self.directions, len(texts)))

        return encode


def _weights(row: np.ndarray, column: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(n)) * idf[column]
    if not len(row):
        return w
    length = np.sqrt(np.bincount(row, w * w))
    return w / np.maximum(length[row], 1e-300)


def _cuts(row: np.ndarray) -> list[tuple[int, int, int]]:
    """row, begin and end of each row that has words."""
    if not len(row):
        return []
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    return list(zip(row[first].tolist(), first.tolist(), [*first[1:].tolist(), len(row)]))


def _product(row: np.ndarray, column: np.ndarray, w: np.ndarray, m: np.ndarray, rows: int) -> np.ndarray:
    """The sparse rows times m."""
    out = np.zeros((rows, m.shape[1]))
    for r, a, b in _cuts(row):
        out[r] = w[a:b] @ m.take(column[a:b], 0)
    return out


def _there_and_back(row: np.ndarray, column: np.ndarray, w: np.ndarray, m: np.ndarray, out: np.ndarray) -> None:
    """Add the sparse rows' transpose times the sparse rows times m to out. A row names a bucket once."""
    for _, a, b in _cuts(row):
        c, x = column[a:b], w[a:b]
        held = out.take(c, 0)
        held += np.outer(x, x @ m.take(c, 0))
        out[c] = held


def _unit(out: np.ndarray) -> np.ndarray:
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """row, bucket, number of slices of written sparse rows, and the slice."""
    for part in small([batch]):
        lists, numbers = (part.column(part.schema.get_field_index(c)) for c in (BUCKET, N))
        row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
        yield row, lists.flatten().to_numpy().astype(np.int64), numbers.flatten().to_numpy(), part


def _summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of what ``partial`` gives for each task's rows, an array of that shape; summed by ranges of its rows. Each task sends such
    an array, so tasks are as many as the cluster's cores, however many splits the rows have."""
    rows = rows.select(BUCKET, N).coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = partial(batches)
        for at in range(0, shape[0], RANGE):
            part = np.ascontiguousarray(m[at : at + RANGE])
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.tobytes()])], names=["at", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[at] = sums.get(at, 0) + np.frombuffer(m, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["at", "m"])

    out = np.zeros(shape)
    for r in rows.mapInArrow(emit, "at long, m binary").repartition("at").mapInArrow(add, "at long, m binary").toLocalIterator():
        out[r["at"] : r["at"] + RANGE] = np.frombuffer(bytes(r["m"]), np.float64).reshape(-1, shape[1])
    return out


def counted(docs: DataFrame, buckets: int = 1 << 16, text: str = "text") -> DataFrame:
    """docs with sparse rows in place of their texts, written: BUCKET and N, arrays of the buckets of a text's words and their numbers."""
    others = [c for c in docs.columns if c != text]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            row, column, n = sparse(b.column(b.num_columns - 1), buckets)
            cut = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(v.astype(np.int32))) for v in (column, n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], names=[*others, BUCKET, N])

    schema = StructType([*docs.select(*others).schema.fields, *(StructField(c, ArrayType(IntegerType())) for c in (BUCKET, N))])
    return scratch.written(docs.select(*others, F.col(text).cast("string")).mapInArrow(made, schema), "sparse")


def vectors(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """Rows of counted() with their embedding array<float> in place of words: what fitted() gives for their texts, which are not
    split and hashed again."""
    others = [c for c in rows.columns if c not in (BUCKET, N)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, column, n, part in _rows(b):
                out = _unit(_product(row, column, _weights(row, column, n, fitted.idf), fitted.directions, part.num_rows))
                cut = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.ListArray.from_arrays(cut, pa.array(out.ravel()))], names=[*others, "embedding"])

    schema = StructType([*rows.select(*others).schema.fields, StructField("embedding", ArrayType(FloatType()))])
    return rows.select(*others, BUCKET, N).mapInArrow(run, schema)


def fit(docs: DataFrame, dim: int = 64, buckets: int = 1 << 16, more: int = 16, passes: int = 3, seed: int = 1, text: str = "text") -> Fitted:
    """``dim`` directions of docs' texts, from ``more`` further random ones and ``passes`` products. Some 3 x buckets x (dim + more)
    numbers are held by each task and the driver: 126 MB by default."""
    return fit_counted(counted(docs.select(text), buckets, text), dim, buckets, more, passes, seed)


def fit_counted(rows: DataFrame, dim: int = 64, buckets: int = 1 << 16, more: int = 16, passes: int = 3, seed: int = 1) -> Fitted:
    """fit() of rows of counted(), whose rows without words are no documents."""
    rows = rows.where(F.size(BUCKET) > 0)

    def seen(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n = np.zeros(buckets)
        for b in batches:
            n += np.bincount(b.column(b.schema.get_field_index(BUCKET)).flatten().to_numpy(), minlength=buckets)
        return n[:, None]

    total = rows.count()
    found = _summed(rows, seen, (buckets, 1))[:, 0]
    idf = np.log((1 + total) / (1 + found)) + 1
    wide = min(dim + more, buckets)

    def times(m: np.ndarray, gram: bool) -> np.ndarray:
        """The matrix's transpose times the matrix times m; gram: m's transpose before that."""

        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((wide, wide) if gram else (buckets, wide))
            for b in batches:
                for row, column, n, part in _rows(b):
                    w = _weights(row, column, n, idf)
                    if gram:
                        found = _product(row, column, w, m, part.num_rows)
                        out += found.T @ found
                    else:
                        _there_and_back(row, column, w, m, out)
            return out

        return _summed(rows, partial, (wide, wide) if gram else (buckets, wide))

    q = np.random.default_rng(seed).standard_normal((buckets, wide))
    for _ in range(passes):
        q = np.linalg.qr(times(q, False))[0]
    values, turn = np.linalg.eigh(times(q, True))
    order = np.argsort(-values)[:dim]
    directions = q @ turn[:, order]
    directions *= np.where(directions[np.abs(directions).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
    return Fitted(idf, directions if total else np.zeros_like(directions), np.sqrt(np.maximum(values[order], 0)))
