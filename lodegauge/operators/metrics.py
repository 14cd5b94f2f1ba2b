"""Ranking metrics of runs against relevance judgments, as windows and aggregates.

A run is (strategy, qid, chunk_id, score); judgments are (strategy, qid, chunk_id, rel). Only queries that both have are
evaluated. Within a query chunks are ordered by score as 32-bit float, ties by greater chunk_id; ranks in the input are
not used. A query without relevant chunks scores 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["strategy", "qid"]
#: Column order of a summary (fixed values).
MEASURES = ("map", "ndcg_cut_10", "P_5", "P_10", "recall_100", "recall_20", "num_ret", "num_rel", "num_rel_ret", "recip_rank")


def parse_qrels(lines: DataFrame) -> DataFrame:
    """(strategy, line_no, value) lines of four fields to judgments; malformed lines go, the last of a (qid, chunk_id)
    counts."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.select("strategy", "line_no", f.alias("f")).where(F.size("f") == 4)
    rows = rows.select("strategy", "line_no", F.get("f", 0).alias("qid"), F.get("f", 2).alias("chunk_id"), F.expr("try_cast(get(f, 3) as int)").alias("rel")).where("rel is not null")
    return rows.groupBy("strategy", "qid", "chunk_id").agg(F.max_by("rel", "line_no").alias("rel"))


def parse_run(lines: DataFrame) -> DataFrame:
    """(strategy, line_no, value) lines of six fields to a run; malformed lines go, the last of a (qid, chunk_id)
    counts."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = lines.select("strategy", "line_no", f.alias("f")).where(F.size("f") == 6)
    rows = rows.select("strategy", "line_no", F.get("f", 0).alias("qid"), F.get("f", 2).alias("chunk_id"), F.expr("try_cast(get(f, 4) as double)").alias("score")).where("score is not null")
    return rows.groupBy("strategy", "qid", "chunk_id").agg(F.max_by("score", "line_no").alias("score"))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run's rows of evaluated queries: strategy, qid, chunk_id, rank, rel, num_rel, ideal (ideal gains at 10)."""
    by_gain = Window.partitionBy(*KEY).orderBy(F.desc("rel"))
    q = qrels.where("rel is not null").withColumn("i", F.row_number().over(by_gain))
    ideal = q.groupBy(*KEY).agg(
        F.count_if(F.col("rel") > 0).alias("num_rel"),
        F.sum(F.when(F.col("i") <= 10, F.greatest(F.col("rel"), F.lit(0)) / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("ideal"),
    )
    order = Window.partitionBy(*KEY).orderBy(F.desc(F.col("score").cast("float")), F.desc("chunk_id"))
    ranked = run.select(*KEY, "chunk_id", "score").join(ideal, KEY).withColumn("rank", F.row_number().over(order))
    return ranked.join(qrels.select(*KEY, "chunk_id", "rel"), [*KEY, "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def per_query(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """All measures of every evaluated query."""
    return measured(judged(run, qrels))


def measured(rows: DataFrame) -> DataFrame:
    """All measures of every query of judged rows."""
    seen = Window.partitionBy(*KEY).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (F.col("rel") > 0).cast("int")
    rows = rows.withColumn("hit", hit).withColumn("found", F.sum("hit").over(seen))
    at = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    r = F.max("num_rel")
    part = lambda c: F.coalesce(F.try_divide(c, r), F.lit(0.0))
    gain = F.sum(F.when(F.col("rank") <= 10, F.greatest(F.col("rel"), F.lit(0)) / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    return rows.groupBy(*KEY).agg(
        part(F.sum(F.when(F.col("hit") == 1, F.col("found") / F.col("rank")).otherwise(0.0))).alias("map"),
        F.coalesce(F.try_divide(gain, F.max("ideal")), F.lit(0.0)).alias("ndcg_cut_10"),
        (at(5) / 5).alias("P_5"), (at(10) / 10).alias("P_10"), part(at(100)).alias("recall_100"), part(at(20)).alias("recall_20"),
        F.count("*").alias("num_ret"), r.alias("num_rel"), F.sum("hit").alias("num_rel_ret"),
        F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("recip_rank"),
    )


def summary(run: DataFrame, qrels: DataFrame, decimals: int = 4) -> DataFrame:
    """A row a strategy: counts are summed over queries, everything else is averaged."""
    return summed(per_query(run, qrels), decimals)


def summed(q: DataFrame, decimals: int = 4) -> DataFrame:
    """summary() of what per_query() or measured() gives."""
    total = lambda m: F.sum(m).cast("long").alias(m) if m.startswith("num_") else F.round(F.avg(m), decimals).alias(m)
    return q.groupBy("strategy").agg(*map(total, MEASURES)).select("strategy", *MEASURES)


def ags_at_k(run: DataFrame, aligned: DataFrame, k: int = 20) -> DataFrame:
    """Group success: strategy, qid, group, success. aligned: (strategy, qid, group, logic, span_no, chunk_id), the
    chunks that cover each span (null: none). A group of logic AND succeeds when every span has a chunk among the first
    k, any other group when one has."""
    order = Window.partitionBy(*KEY).orderBy(F.desc(F.col("score").cast("float")), F.desc("chunk_id"))
    top = run.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select(*KEY, "chunk_id", F.lit(True).alias("in_top"))
    spans = aligned.join(top, [*KEY, "chunk_id"], "left").groupBy(*KEY, "group", "logic", "span_no").agg(F.bool_or(F.coalesce("in_top", F.lit(False))).alias("covered"))
    return spans.groupBy(*KEY, "group").agg(F.when(F.max("logic") == "AND", F.bool_and("covered")).otherwise(F.bool_or("covered")).alias("success"))
