"""Connected components over written edges, in rounds.

Each round begins in the partitions: a partition's edges, bounded in number, are contracted to stars by union and find.
Edges that fit one partition are done then. Otherwise the stars go through a large-star and a small-star step, which join
every edge with the least neighbour of one end; hubs are reduced by partial minima before the exchange and split by the
adaptive join, so neither links nor components are ever gathered beyond a partition's bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegauge.sources import scratch

#: Edges of a partition.
PART_EDGES = 400_000
_EDGE = "u long, v long"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as (node, least node that they connect it to)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p, q = root(u), root(v)
            if p != q:
                up[max(p, q)] = min(p, q)
    found = [(x, root(x)) for x in list(up)]
    found = [f for f in found if f[0] != f[1]]
    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs, in any order and repeated at will; returns (node, component), component being the least
    node reachable, for every node with an edge to a smaller node, as a written table. Loops and nulls are ignored."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = scratch.written(e, "edges"), None
    while True:
        parts = -(-e.count() // PART_EDGES)
        stars = scratch.written(e.coalesce(max(1, parts)).mapInArrow(_stars, _EDGE), "stars")
        scratch.drop(e)
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if parts <= 1 or now == seen:
            out = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out._scratch_path = stars._scratch_path
            return out
        seen = now
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(stars, large)
