"""Exact top-k search by inner product with block-at-a-time pruning.

A vector is a document whose terms are its components. Documents are range-sorted by their leading term, its sign and
their key, and cut into ranges: cells of up to CELL, and in a cell blocks of BLOCK. Both keep the greatest and least
weight of each term, and cells their forward index, a dense matrix. For a query, a range's bound is the sum over terms of
the most that its extremes allow.

A query is first searched in the cell that it is itself a row of, which needs nothing to travel and gives a score that
the k-th best can't fall below. Its bounds for all other cells come from their extremes alone, CHUNK cells at a time, and
the query goes only to the cells whose bound reaches that score. In a cell, blocks are visited in order of falling bounds,
each scored through the forward index, until the bound of the next lies below the k-th score. Equal bounds are still
visited, as ties go to the smaller key, so the result is exact. Documents travel twice, however many queries there are;
each meeting of a query and a cell leaves at most k rows, and these few are merged.

Weights are floor(scale * x). Scores are integers: float64 products are used where every partial sum stays below 2**53,
Python integers elsewhere; scores beyond the range of a long stop at its ends, and tie there.

Nulls: null vectors, and vectors with a null or non-finite component (or one whose scale-fold is not finite) or a null
key, take no part. Vectors of different lengths are compared as if the shorter had zeros at its end; empty vectors score
0. Rows that repeat a key are candidates each by itself, but never for a query with that key; those that are queries are
each asked by itself and have k results each, with ranks from 1. Ties go to the smaller key. Extra columns are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegauge.sources import scratch

#: Documents of a cell, cells whose extremes travel together, documents of a block.
CELL, CHUNK, BLOCK = 8192, 1024, 64
#: Range partitions at most; beyond it they hold several cells.
MOST_PARTS = 1 << 16
LEAST = np.iinfo(np.int64).min
CELLS = "cell long, ids binary, asks binary, width int, kind string, m binary, high binary, low binary"
ASKED = "cell long, ids binary, asks binary, width int, kind string, m binary, least binary"
SCHEMA = "query_id long, vec_id long, score long, ask long"


def _quantized(vectors: DataFrame, scale: int, ask: Column) -> DataFrame:
    """vec_id, x (whole numbers as doubles, which hold them exactly) and ask."""
    x = F.transform("embedding", lambda v: _floor(v.cast("double") * scale))
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double") * scale) < float("inf"))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    return good.select(F.col("vec_id").cast("long"), x.alias("x"), ask.alias("ask"))


def _floor(v: Column) -> Column:
    """floor() of a double as a double; from 2**53 on every double is whole."""
    return F.when(F.abs(v) < float(1 << 53), F.floor(v).cast("double")).otherwise(v)


def _packed(m: np.ndarray) -> tuple[str, bytes]:
    """A matrix of whole numbers in the least type that holds them."""
    most = np.abs(m).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return kind, m.astype(kind).tobytes()


def _matrix(raw: bytes, kind: str, n: int, width: int, wide: int) -> np.ndarray:
    m = np.zeros((n, max(width, wide)))
    m[:, :width] = np.frombuffer(raw, kind).reshape(n, width)
    return m


def _product(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact products of two matrices of whole numbers, as longs."""
    if not q.size or not d.size:
        return np.zeros((len(q), len(d)), np.int64)
    most = int(np.abs(q).max()) * int(np.abs(d).max()) * q.shape[1]
    if most < 1 << 53:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(d).T
    return np.clip(exact, LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


def _bound(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that rows between low and high can score, for each query and range."""
    wide = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    return _product(wide, np.concatenate([high, low], axis=1))


def search_cell(qid: np.ndarray, q: np.ndarray, least: np.ndarray, did: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vec_id, score) of the k best documents of the cell for each query, [query, k]; score LEAST where there is none.
    least: a score that documents have to reach to matter."""
    at = np.arange(0, len(d), BLOCK)
    bound = _bound(q, np.maximum.reduceat(d, at, axis=0), np.minimum.reduceat(d, at, axis=0))
    visit = np.argsort(-np.maximum(bound, LEAST + 1), axis=1, kind="stable")
    best_s, best_d = np.full((len(q), k), LEAST), np.full((len(q), k), np.iinfo(np.int64).max)
    alive = np.arange(len(q))
    for turn in range(len(at)):
        block = visit[alive, turn]
        alive_now = bound[alive, block] >= np.maximum(best_s[alive, k - 1], least[alive])
        alive, block = alive[alive_now], block[alive_now]
        if not len(alive):
            break
        by = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[by])) + 1
        for who in np.split(by, cuts):
            rows, b = alive[who], at[block[who[0]]]
            ids = did[b : b + BLOCK]
            score = _product(q[rows], d[b : b + BLOCK])
            mine = np.broadcast_to(ids, score.shape)
            s = np.concatenate([best_s[rows], np.where(mine == qid[rows][:, None], LEAST, score)], axis=1)
            i = np.concatenate([best_d[rows], mine], axis=1)
            top = np.lexsort((i, -(s + 1)), axis=1)[:, :k]
            best_s[rows], best_d[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    return best_d, best_s


def _cells(size: int):
    """Rows (vec_id, x, ask) in order to cells: a row a cell, with its forward index and extremes. ask is -1 where the
    row is no query."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def out():
            ids, asks = (np.array([h[i] for h in held], np.int64) for i in (0, 2))
            width = max(len(h[1]) for h in held)
            m = np.zeros((len(held), width))
            for i, h in enumerate(held):
                m[i, : len(h[1])] = h[1]
            kind, raw = _packed(m)
            row = [(part << 32) + made, ids.tobytes(), asks.tobytes(), width, kind, raw, m.max(0).tobytes(), m.min(0).tobytes()]
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["cell", "ids", "asks", "width", "kind", "m", "high", "low"])

        for b in batches:
            x = b.column(1)
            flat, lengths = x.flatten().to_numpy(zero_copy_only=False), x.value_lengths().to_numpy()
            ends = np.cumsum(lengths)
            for key, n, end, ask in zip(b.column(0).to_pylist(), lengths, ends, b.column(2).to_pylist()):
                held.append((key, flat[end - n : end], ask))
                if len(held) == size:
                    yield out()
                    held, made = [], made + 1
        if held:
            yield out()

    return f


def _found(qid: np.ndarray, ask: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    real = scores > LEAST
    n = ids.shape[1]
    columns = (np.repeat(qid, n).reshape(-1, n)[real], ids[real], scores[real], np.repeat(ask, n).reshape(-1, n)[real])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "ask"])


def _own(k: int):
    """Each cell's queries searched in the cell itself: ASKED, with the k-th score that is certain, and the results."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, asks = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["asks"], np.int64)
                d, who = _matrix(r["m"], r["kind"], len(ids), r["width"], 0), np.flatnonzero(asks >= 0)
                best, score = search_cell(ids[who], d[who], np.full(len(who), LEAST), ids, d, k)
                kind, raw = _packed(d[who])
                row = [r["cell"], ids[who].tobytes(), asks[who].tobytes(), r["width"], kind, raw, score[:, -1].tobytes()]
                found = _found(ids[who], asks[who], best, score)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in found.columns]
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(row, types)), *lists], names=["cell", "ids", "asks", "width", "kind", "m", "least", *found.schema.names])

    return f


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of queries next to the extremes of some cells: the queries once more for each cell that they have to see."""
    for b in batches:
        for r in b.to_pylist():
            n = len(r["ids"]) // 8
            wide = max([r["width"], *(x["width"] for x in r["ranges"])])
            q, least = _matrix(r["m"], r["kind"], n, r["width"], wide), np.frombuffer(r["least"], np.int64)
            ids, asks = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["asks"], np.int64)
            high, low = (np.concatenate([_matrix(x[c], "<f8", 1, x["width"], wide) for x in r["ranges"]]) for c in ("high", "low"))
            sees = _bound(q, high, low) >= least[:, None]
            for i, x in enumerate(r["ranges"]):
                who = np.flatnonzero(sees[:, i])
                if x["cell"] == r["cell"] or not len(who):
                    continue
                kind, raw = _packed(q[who])
                row = [x["cell"], ids[who].tobytes(), asks[who].tobytes(), wide, kind, raw, least[who].tobytes()]
                types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=["cell", "ids", "asks", "width", "kind", "m", "least"])


def _searched(k: int):
    """Rows come sorted by cell, the cell's documents (least is null) first, then the queries that it has to see."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for r in b.to_pylist():
                if r["least"] is None:
                    held = r
                    continue
                did, qid = np.frombuffer(held["ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                wide = max(held["width"], r["width"])
                d, q = _matrix(held["m"], held["kind"], len(did), held["width"], wide), _matrix(r["m"], r["kind"], len(qid), r["width"], wide)
                yield _found(qid, np.frombuffer(r["asks"], np.int64), *search_cell(qid, q, np.frombuffer(r["least"], np.int64), did, d, k))

    return f


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """Per query its k best others: query_id, rank (from 1), vec_id, score."""
    ask = F.when(F.coalesce(is_query, F.lit(False)), F.monotonically_increasing_id()).otherwise(-1)
    sizes = F.transform("x", lambda v: F.abs(v))
    lead = F.coalesce(F.array_position(sizes, F.array_max(sizes)), F.lit(0)).cast("int")
    rows = _quantized(vectors, scale, ask).withColumn("lead", lead)
    rows = scratch.written(rows.withColumn("side", F.get("x", F.col("lead") - 1) < 0), "vectors")
    parts = max(1, min(-(-rows.count() // CELL), MOST_PARTS))
    dealt = rows.repartitionByRange(parts, "lead", "side", "vec_id").sortWithinPartitions("lead", "side", "vec_id")
    cells = scratch.written(dealt.select("vec_id", "x", "ask").mapInArrow(_cells(CELL), CELLS), "cells")
    asked = scratch.written(
        cells.mapInArrow(_own(k), f"{ASKED}, query_id array<long>, vec_id array<long>, score array<long>, ask array<long>"), "asked"
    )
    names = [c.split()[0] for c in ASKED.split(", ")]
    number = max(1, cells.count())
    packs = -(-number // CHUNK)
    ranges = cells.groupBy(F.pmod(F.xxhash64("cell"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("cell", "width", "high", "low")).alias("ranges"))
    some = asked.where(F.octet_length("ids") > 0).select(*names)
    both = some.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long")))).join(ranges, "pack").drop("pack")
    sent = scratch.written(both.mapInArrow(_sent, ASKED), "sent")
    meet = cells.join(sent.select("cell").distinct(), "cell", "left_semi").select(*names[:-1], F.lit(None).cast("binary").alias("least")).union(sent)
    meet = meet.repartition(min(number, MOST_PARTS), "cell").sortWithinPartitions("cell", F.col("least").asc_nulls_first())
    own = asked.select(F.explode(F.arrays_zip("query_id", "vec_id", "score", "ask")).alias("r")).select("r.*")
    partial = own.union(meet.mapInArrow(_searched(k), SCHEMA))
    order = Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH good AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.x, d.x)::BIGINT AS score
  FROM good q JOIN good d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
