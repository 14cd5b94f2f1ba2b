"""Spans aligned to chunks by coverage, and the search for thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegauge.operators.spans import overlap

T_SPAN, T_CHUNK = 0.85, 0.50
#: The threshold grid (fixed values).
SPAN_GRID = (0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
CHUNK_GRID = (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5)


def overlapping_pairs(spans: DataFrame, chunks: DataFrame, bucket: int | None = None) -> DataFrame:
    """Span and chunk pairs of a document that overlap: qid, docid, chunk_id, strategy (if chunks have it), cov_span,
    cov_chunk.

    The join is on docid. bucket: also on ``bucket`` characters of the text, for long documents with many spans: both
    sides are listed under each bucket they touch, and a pair counts in the first bucket that both touch, so nothing is
    paired twice and no distinct is needed.
    """
    s = spans.where("start < `end`").select("qid", "docid", F.col("start").alias("s"), F.col("end").alias("e"), *[c for c in ("logic", "group", "span_no") if c in spans.columns])
    c = chunks.where("start < `end`").select(F.col("docid"), "chunk_id", F.col("start").alias("cs"), F.col("end").alias("ce"), *[x for x in ("strategy",) if x in chunks.columns])
    on = ["docid"]
    if bucket:
        touch = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor((F.col(b) - 1) / bucket)))
        s, c, on = s.withColumn("bucket", touch("s", "e")), c.withColumn("bucket", touch("cs", "ce")), ["docid", "bucket"]
    pairs = s.join(c, on).where("s < ce and cs < e")
    if bucket:
        pairs = pairs.where(F.col("bucket") == F.greatest(F.floor(F.col("s") / bucket), F.floor(F.col("cs") / bucket))).drop("bucket")
    shared = overlap(F.col("s"), F.col("e"), F.col("cs"), F.col("ce"))
    return pairs.withColumn("cov_span", shared / (F.col("e") - F.col("s"))).withColumn("cov_chunk", shared / (F.col("ce") - F.col("cs"))).drop("s", "e", "cs", "ce")


def aligned_pairs(spans: DataFrame, chunks: DataFrame, t_span: float = T_SPAN, t_chunk: float = T_CHUNK, bucket: int | None = None) -> DataFrame:
    return overlapping_pairs(spans, chunks, bucket).where((F.col("cov_span") >= t_span) & (F.col("cov_chunk") >= t_chunk))


def align(spans: DataFrame, chunks: DataFrame, t_span: float = T_SPAN, t_chunk: float = T_CHUNK, bucket: int | None = None) -> DataFrame:
    """Relevance judgments: distinct (strategy,) qid, chunk_id with iter '0' and rel 1."""
    pairs = aligned_pairs(spans, chunks, t_span, t_chunk, bucket)
    keys = [c for c in ("strategy", "qid", "chunk_id") if c in pairs.columns]
    return pairs.select(*keys).distinct().withColumn("iter", F.lit("0")).withColumn("rel", F.lit(1))


def align_counts(spans: DataFrame, chunks: DataFrame, t_span: float = T_SPAN, t_chunk: float = T_CHUNK, bucket: int | None = None) -> DataFrame:
    """By strategy: alignments, distinct judgments, queries."""
    pairs = aligned_pairs(spans, chunks, t_span, t_chunk, bucket)
    return pairs.groupBy("strategy").agg(F.count("*").alias("alignments"), F.countDistinct("qid", "chunk_id").alias("judgments"), F.countDistinct("qid").alias("queries"))


def align_char_windows(spans: DataFrame, lengths: DataFrame, size: int = 500, overlap_chars: int = 50, t_span: float = T_SPAN, t_chunk: float = T_CHUNK) -> DataFrame:
    """align() for char windows by arithmetic: the windows that a span meets follow from its offsets, so chunks are
    neither made nor joined; only the documents' lengths are. lengths: docid, n (characters of the normalized text)."""
    step = size - overlap_chars
    rows = spans.where("start < `end`").join(lengths, "docid").where("n > 0")
    last = F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / step)
    first = F.greatest(F.floor((F.col("start") - size) / step) + 1, F.lit(0))
    final = F.least(last, F.floor((F.col("end") - 1) / step))
    met = rows.withColumn("i", F.explode(F.when(first <= final, F.sequence(first.cast("long"), final.cast("long")))))
    cs, ce = F.col("i") * step, F.least(F.col("i") * step + size, F.col("n"))
    shared = overlap(F.col("start"), F.col("end"), cs, ce)
    good = met.where((shared > 0) & (shared / (F.col("end") - F.col("start")) >= t_span) & (shared / (ce - cs) >= t_chunk))
    name = F.concat(F.lit(f"CHARWIN{size}OV{overlap_chars}-"), "docid", F.lit("-"), F.format_string("%04d", "i"))
    return good.select("qid", name.alias("chunk_id")).distinct().withColumn("iter", F.lit("0")).withColumn("rel", F.lit(1))


def threshold_grid(pairs: DataFrame, span_grid: tuple = SPAN_GRID, chunk_grid: tuple = CHUNK_GRID) -> DataFrame:
    """For each pair of thresholds: t_span, t_chunk, n, avg_span, avg_chunk, f (harmonic mean of the means, 0 if none).

    A pair counts once, in the cell of the greatest thresholds that it passes; the grid is then summed from the strict
    end over these few cells, so nothing is multiplied by the size of the grid.
    """
    # coverages are named once each, as the planner puts their expressions in place of their names: the sum of a grid's comparisons
    # would be code too long to be compiled, and as a filter would be worked out for all pairs that share a bucket
    reached = lambda c, grid: F.size(F.filter(F.array_repeat(F.col(c), len(grid)), lambda x, i: x >= F.get(F.array(*map(F.lit, grid)), i)))
    some = pairs.select("cov_span", "cov_chunk").where((F.col("cov_span") >= min(span_grid)) & (F.col("cov_chunk") >= min(chunk_grid)))
    cells = some.groupBy(reached("cov_span", span_grid).alias("a"), reached("cov_chunk", chunk_grid).alias("b")).agg(F.count("*").alias("n"), F.sum("cov_span").alias("cs"), F.sum("cov_chunk").alias("cc"))
    grid = pairs.sparkSession.createDataFrame(
        [(i + 1, j + 1, float(s), float(c)) for i, s in enumerate(span_grid) for j, c in enumerate(chunk_grid)], "i int, j int, t_span double, t_chunk double"
    )
    total = F.broadcast(grid).join(cells, (F.col("a") >= F.col("i")) & (F.col("b") >= F.col("j")), "left").groupBy("i", "j", "t_span", "t_chunk").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.sum("cs").alias("cs"), F.sum("cc").alias("cc")
    )
    mean = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    both = mean("cs") + mean("cc")
    f = F.when(both > 0, 2 * mean("cs") * mean("cc") / both).otherwise(F.lit(0.0))
    return total.select("t_span", "t_chunk", "n", F.round(mean("cs"), 9).alias("avg_span"), F.round(mean("cc"), 9).alias("avg_chunk"), F.round(f, 9).alias("f"))


def threshold_best(grid: DataFrame) -> DataFrame:
    """The best cell: greatest f, then most alignments, then first in the grid."""
    return grid.orderBy(F.desc("f"), F.desc("n"), "t_span", "t_chunk").limit(1)
