"""The per-document operators as streams: chunking and alignment keep no state, so they run unchanged on a stream of
documents, joined to static spans. Counts by window keep the windows that are open; spans are merged in streaming.merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegauge.operators.alignment import aligned_pairs
from lodegauge.operators.chunking import char_windows


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def aligned_stream(docs: DataFrame, spans: DataFrame, chunker: Callable[[DataFrame], DataFrame] = char_windows, t_span: float = 0.85, t_chunk: float = 0.5) -> DataFrame:
    """docs: a stream of (docid, text). Aligned pairs of its chunks with static spans, as documents arrive."""
    return aligned_pairs(spans, chunker(docs), t_span, t_chunk)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of event time; later ones than ``late`` are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))


def run_once(stream: DataFrame, name: str | None, checkpoint: str, path: str) -> None:
    """Process what is there and stop; the checkpoint makes a later call go on from there."""
    writer = stream.writeStream.queryName(name) if name else stream.writeStream
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start()
    q.awaitTermination()


def run_updates(counts: DataFrame, checkpoint: str, path: str) -> None:
    """Process what is there and stop. Each micro-batch writes the rows that it changed into a folder of its own under
    ``path``, and again into the same one if it is repeated; latest() gives what holds of them. Rows whose event time has passed
    leave the state."""
    q = counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}")).start()
    q.awaitTermination()


def latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The last row of each key that run_updates() wrote."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")
