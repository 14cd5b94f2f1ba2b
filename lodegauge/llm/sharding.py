"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for a key, ``-ln(u(key, shard)) / weight``, and the least number wins. A shard's draw depends
on nothing but the key and the shard, so a further shard takes over just the keys for which it draws the least, and no
key moves between the old ones; a shard of weight w gets a share proportional to w.

Slots number the rows of a shard from 0 without gaps. They come from running numbers inside pieces (the scan's own
partitions, cut into further pieces by row number), written down once, plus the offset of each piece; a shard of any
size, or a key that holds a third of all rows, is never gathered into one task.

Nulls: a null text has size 8 and the checksum of the empty text; null keys share one shard, as equal keys do. Ties of
draws go to the smaller shard. Repeated rows each get a slot of their own. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegauge.sources import scratch

#: Rows of one piece of a scan partition that are numbered together.
PIECE_ROWS = 1 << 18


def rendezvous(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(draw, shard) of the winning shard among first, first + 1, ..."""
    draws = []
    for shard, weight in enumerate(weights, start=first):
        # 53 bits of a keyed hash, never 0
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11).cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(shard).alias("shard")))
    return F.least(*draws) if len(draws) > 1 else draws[0]


def shard_records(docs: DataFrame, weights: list[float], grown_weight: float = 1.0) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard once one more is added).

    The only exchange carries five numbers a row.
    """
    n = len(weights)
    text = F.coalesce("text", F.lit(""))
    placed = (
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.monotonically_increasing_id().alias("at"),
        )
        .withColumn("best", rendezvous(F.col("doc_id"), weights))
        .withColumn("new", rendezvous(F.col("doc_id"), [grown_weight], first=n))
        .select(
            "doc_id", "size", "text_crc32", "at",
            F.col("best.shard").alias("shard"),
            F.when(F.col("new.draw") < F.col("best.draw"), n).otherwise(F.col("best.shard")).alias("grown_shard"),
            F.floor(F.col("at") / PIECE_ROWS).alias("piece"),
        )
    )
    within = Window.partitionBy("piece", "shard").orderBy("at")
    numbered = scratch.written(placed.withColumn("nth", F.row_number().over(within) - 1).drop("at"), "sharding")
    # one row per piece and shard: pieces are rows / PIECE_ROWS
    counts = numbered.groupBy("shard", "piece").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.written(
        counts.select("shard", "piece", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")), "offsets"
    )
    return numbered.join(offsets, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("nth")).cast("long").alias("slot"), "grown_shard",
    )
