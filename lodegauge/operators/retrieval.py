"""Dense retrieval: embedding through an injectable encoder, cosine top-k in blocks."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from lodegauge.functions.text import small
from lodegauge.sources import scratch

#: Rows that are looked at together; chunks of a piece, which a task holds while queries pass by; pivots at most.
BLOCK, HOLD, PIVOTS = 4096, 16384, 1024


def hashed_encoder(dim: int = 256) -> Callable[[list[str]], np.ndarray]:
    """The offline default: signed hashed word features, unit length. Same texts, same vectors, on any machine. Words are what ASCII
    white space separates. Where the signs of a text's words cancel out to nothing, its words count without signs, so only texts
    without a word have no direction."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            at = []
            for w, n in Counter(re.findall(r"[^ \t-\r]+", (t or "").lower())).items():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                at.append((h % dim, n))
                out[i, h % dim] += n if h >> 63 else -n
            if at and not out[i].any():
                for k, n in at:
                    out[i, k] += n
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-12)

    return encode


def embed(rows: DataFrame, make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_encoder, text: str = "text", batch: int = 32) -> DataFrame:
    """rows with embedding array<float>. The encoder is made once a worker and fed ``batch`` texts at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for b in small(parts):
            texts = [t or "" for t in b.column(text).to_pylist()]
            got = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield b.append_column("embedding", pa.array(got, pa.list_(pa.float32())))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def mean_pool(rows: DataFrame, tokens: str = "token_vectors", mask: str = "mask") -> DataFrame:
    """Mean of the token vectors whose mask is 1, scaled to unit length: token_vectors array<array<float>>, mask
    array<int>."""
    kept = F.filter(F.arrays_zip(F.col(tokens).alias("v"), F.col(mask).alias("m")), lambda x: x["m"] == 1)
    total = F.aggregate(kept, F.array().cast("array<double>"), lambda acc, x: F.when(F.size(acc) == 0, x["v"].cast("array<double>")).otherwise(F.zip_with(acc, x["v"], lambda a, b: a + b)))
    out = rows.withColumn("__sum", total).withColumn("__n", F.sqrt(F.aggregate("__sum", F.lit(0.0), lambda s, x: s + x * x)))
    return out.withColumn("embedding", F.transform("__sum", lambda x: (F.try_divide(x, F.col("__n"))).cast("float"))).drop("__sum", "__n")


def _matrix(batch: pa.RecordBatch, column: int, dim: int = 0) -> np.ndarray:
    """A column of arrays as rows of doubles, with zeros after shorter ones; ``dim`` columns at least."""
    lists = batch.column(column)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((batch.num_rows, max(dim, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _angles(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of rows to pivots, and lengths of rows; a zero row is at a right angle to all."""
    wide = max(m.shape[1], pivots.shape[1])
    grow = lambda x: np.pad(x, ((0, 0), (0, wide - x.shape[1])))
    length = np.linalg.norm(m, axis=1)
    return np.arccos(np.clip(grow(m / np.maximum(length, 1e-300)[:, None]) @ grow(pivots).T, -1, 1)), length


@dataclass
class Bounds:
    """summary: for each cell that has chunks, its number n of them, the least and greatest angle to its pivot (low, high), and
    the least and greatest length (shortest, longest)."""

    pivots: np.ndarray
    summary: dict[str, np.ndarray]

    def of(self, m: np.ndarray) -> np.ndarray:
        """What the products of rows with chunks of each cell cannot exceed: angles obey the triangle inequality."""
        angle, length = _angles(m, self.pivots[self.summary["cell"]])
        away = np.maximum(0, np.maximum(angle - self.summary["high"], self.summary["low"] - angle))
        near = np.cos(np.minimum(away, np.pi))
        # the least length counts where the cosine is negative
        return length[:, None] * np.where(near >= 0, self.summary["longest"] * near, self.summary["shortest"] * near)


@dataclass
class Cells:
    """Chunks by their nearest pivot. vectors: cell, angle, length, id, docid, v."""

    vectors: DataFrame
    bounds: Bounds


def _cells(chunks: DataFrame) -> Cells:
    """Pivots are the PIVOTS chunks at most, or the root of their number, that come first by a hash of their ids; they decide
    nothing but speed."""
    held = scratch.written(chunks, "vectors")
    count = held.count()
    first = held.orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, math.isqrt(count)))).select("v").toArrow().to_batches()
    found = np.concatenate([_matrix(b, 0, max(_matrix(x, 0).shape[1] for x in first)) for b in first]) if count else np.zeros((0, 1))
    length = np.linalg.norm(found, axis=1)
    pivots = found[length > 0] / length[length > 0, None] if (length > 0).any() else np.ones((1, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                angle, size = _angles(_matrix(b, 2), pivots)
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle[np.arange(len(cell)), cell]), pa.array(size), *b.columns], names=["cell", "angle", "length", "id", "docid", "v"])

    vectors = scratch.written(held.select("id", "docid", "v").mapInArrow(assign, "cell long, angle double, length double, id string, docid string, v array<double>"), "cells")
    sums = vectors.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    rows = sums.orderBy("cell").collect()  # a row a pivot
    return Cells(vectors, Bounds(pivots, {k: np.array([r[k] for r in rows], np.int64 if k in ("cell", "n") else np.float64) for k in sums.columns}))


def _asked(queries: DataFrame, cells: Cells, k: int, slack: float) -> DataFrame:
    """key, qid, v and cell: queries (key, qid, v, least) sent to the cells that they are to see. A query whose ``least`` is null
    goes to the cells of the highest bounds that hold k chunks together; with it, to all others whose bounds reach it."""

    bounds = cells.bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = bounds.summary["n"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                bound = bounds.of(_matrix(b, 2))
                order = np.argsort(-bound, axis=1, kind="stable")
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, np.cumsum(n[order], axis=1) - n[order] < k, axis=1)
                least = b.column(3).to_numpy(zero_copy_only=False).astype(float)
                row, cell = np.nonzero(np.where(np.isnan(least)[:, None], first, ~first & (bound >= least[:, None] - slack)))
                for i in range(0, len(row), BLOCK):
                    some = b.take(pa.array(row[i : i + BLOCK]))
                    yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(bounds.summary["cell"][cell[i : i + BLOCK]])], names=["key", "qid", "v", "cell"])

    return queries.select("key", "qid", "v", "least").mapInArrow(run, "key long, qid string, v array<double>, cell long")


def _best(q: list, m: np.ndarray, held: list[tuple], k: int, decimals: int) -> pa.RecordBatch:
    """The k best chunks of the held rows (ids, docids, vectors) for each of the queries q (key, qid) with vectors m."""
    dim = max(x.shape[1] for x in (m, *(h[2] for h in held)))
    grow = lambda x: np.pad(x, ((0, 0), (0, dim - x.shape[1])))
    ids, docids = [x for h in held for x in h[0]], [x for h in held for x in h[1]]
    score = np.round(grow(m) @ np.concatenate([grow(h[2]) for h in held]).T, decimals)
    by_id = np.argsort(np.array([x.encode() for x in ids], dtype=object), kind="stable")[::-1]
    score = score[:, by_id]
    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
    cols = by_id[top.ravel()]
    rows = np.repeat(np.arange(len(q)), top.shape[1])
    return pa.RecordBatch.from_arrays(
        [pa.array([q[i][0] for i in rows], pa.int64()), pa.array([q[i][1] for i in rows], pa.string()), pa.array([ids[j] for j in cols], pa.string()), pa.array([docids[j] for j in cols], pa.string()), pa.array(np.take_along_axis(score, top, 1).ravel())],
        names=["key", "qid", "chunk_id", "docid", "score"],
    )


def _scored(asked: DataFrame, cells: Cells, k: int, decimals: int) -> DataFrame:
    """The k best of each piece of a cell for each query sent there: key, qid, chunk_id, docid, score. Cells are cut into
    pieces of about HOLD chunks by a hash of the id, so one that holds most chunks is many tasks' work."""
    pieces = {int(c): -(-int(n) // HOLD) for c, n in zip(cells.bounds.summary["cell"], cells.bounds.summary["n"])}
    table = asked.sparkSession.createDataFrame(list(pieces.items()) or [(0, 1)], "cell long, pieces long")
    dealt = cells.vectors.join(F.broadcast(table), "cell").select("cell", F.pmod(F.xxhash64("id"), "pieces").alias("piece"), F.lit(False).alias("asks"), F.lit(None).cast("long").alias("key"), "id", "docid", "v")
    sent = asked.join(F.broadcast(table), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(True).alias("asks"), "key", F.col("qid").alias("id"), F.lit(None).cast("string").alias("docid"), "v")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and piece, its chunks first."""
        now, held = None, []
        for b in batches:
            at = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            cuts = [0, *(i for i in range(1, len(at)) if at[i] != at[i - 1]), len(at)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if at[i][:2] != now:
                    now, held = at[i][:2], []
                part = b.slice(i, j - i)
                ids, m = part.column(4).to_pylist(), _matrix(part, 6)
                if not at[i][2]:
                    held.append((ids, part.column(5).to_pylist(), m))
                    continue
                for x in range(0, len(ids) if held else 0, 256):
                    yield _best(list(zip(part.column(3).to_pylist(), ids))[x : x + 256], m[x : x + 256], held, k, decimals)

    both = dealt.join(asked.select("cell").distinct(), "cell", "left_semi").unionByName(sent).repartition("cell", "piece").sortWithinPartitions("cell", "piece", "asks")
    return both.mapInArrow(best, "key long, qid string, chunk_id string, docid string, score double")


@dataclass
class Search:
    """What a search did: found (all candidates), sent (key, cell), the cells, and the number of queries."""

    found: DataFrame
    sent: DataFrame
    cells: Cells
    queries: int

    def share(self) -> float:
        """The share of all pairs of queries and chunks that were scored."""
        n = dict(zip(self.cells.bounds.summary["cell"].tolist(), self.cells.bounds.summary["n"].tolist()))
        rows = self.sent.groupBy("cell").count().collect()  # a row a pivot
        return sum(r["count"] * n[r["cell"]] for r in rows) / max(1, self.queries * sum(n.values()))


def search(queries: DataFrame, chunks: DataFrame, k: int, qid: str = "qid", chunk_id: str = "chunk_id", docid: str | None = None, decimals: int = 8) -> Search:
    """The rounds of retrieve()."""
    vector = F.col("embedding").cast("array<double>").alias("v")
    some = lambda rows, name: rows.where("embedding is not null and size(embedding) > 0").select(F.col(name).cast("string").alias("id"), (F.col(docid) if docid and name == chunk_id else F.lit(None)).cast("string").alias("docid"), vector)
    cells = _cells(some(chunks, chunk_id))
    asks = scratch.written(some(queries, qid).select(F.xxhash64("id", "v").alias("key"), F.col("id").alias("qid"), "v"), "queries")
    slack = 10.0**-decimals + 1e-9
    none = F.lit(None).cast("double").alias("least")
    first = scratch.written(_asked(asks.select("*", none), cells, k, slack), "sent")
    near = scratch.written(_scored(first, cells, k, decimals), "found")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("chunk_id"))
    kth = near.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("key", F.col("score").alias("least"))
    told = asks.join(kth, "key", "left").select("key", "qid", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    more = scratch.written(_asked(told, cells, k, slack), "sent")
    found = near.unionByName(_scored(more, cells, k, decimals))
    return Search(found, first.select("key", "cell").unionByName(more.select("key", "cell")), cells, asks.count())


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 20, qid: str = "qid", chunk_id: str = "chunk_id", docid: str | None = None, decimals: int = 8) -> DataFrame:
    """The k best chunks of each query: qid, chunk_id, rank (from 1), score, and docid if given. Vectors are of unit
    length, so the dot product is the cosine; scores are rounded to ``decimals`` as in run files, and ties go to the
    greater chunk_id. Without a vector, or of no dimension, nothing is found.

    Chunks are dealt to the cells of their nearest pivots. A query first sees the cells that promise most and hold k chunks; its
    k-th score from there rules out every cell whose bound, by the triangle inequality of angles, is below it, and it is sent to
    the others only. Bounds are loose where vectors lie in no clusters; then most cells are seen, and results are the same.
    """
    some = search(queries, chunks, k, qid, chunk_id, docid, decimals).found
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("chunk_id"))
    ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qid", *(["docid"] if docid else []), "chunk_id", "rank", "score")


def as_run(retrieved: DataFrame, run_name: str) -> DataFrame:
    return retrieved.select("qid", F.lit("Q0").alias("q0"), "chunk_id", "rank", "score", F.lit(run_name).alias("run_name"))
