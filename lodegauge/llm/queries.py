"""Thin queries over the operators of this subpackage, and their SQL.

Each applies its operator to its whole table with production parameters; nulls, empty texts, ties, repeated rows and empty
tables have the results that the operators define. Small tables are dealt to all cores first, where results do not depend
on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegauge.llm import collocations, exact_dedup, language_id, lexical_search, mixing, piece_sampling, quality_rules, topk, warc
from lodegauge.llm.jaccard_join import jaccard_components
from lodegauge.llm.sharding import shard_records
from lodegauge.llm.token_counts import token_counts
from lodegauge.llm.toxicity import toxicity
from lodegauge.sources import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scratch.spread(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.new_path(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), folder, shard_bytes=16 << 20, file_bytes=64 << 20, min_revisit=0)
    read = warc.read_archive(spark, folder, payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), "byte_bpe_50k.json", 512)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(_table(spark, sf_dir, "documents"), [1.0] * 24)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), 3, 90)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as a stream follows no single file
    return exact_dedup.dedup(spark, f"{sf_dir}/documents.parque[t]")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"), 20)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir), 4, 30, 2000)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_sharding": op5_sharding,
    "op6_language_id": op6_language_id,
    "op7_piece_sampling": op7_piece_sampling,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_topk": op10_topk,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality_rules.ORACLE, "op4_mixing": mixing.ORACLE, "op10_topk": topk.ORACLE, "op11_exact_dedup": exact_dedup.ORACLE, "op12_lexical_search": lexical_search.ORACLE, "op13_collocations": collocations.ORACLE}
